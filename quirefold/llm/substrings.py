"""Substring deduplication by repeated-phrase automata.

1. Candidates: every document selects short phrases (the least hash among the runs of PHRASE words of each window), so
   that equal windows select equal phrases. Stretches of text around phrases that are selected more than once are kept.
2. Confirmed passages: a window of a stretch that occurs more than once recurs, and belongs to the first document that
   has it. Windows that follow one another in their owner are one passage, so each recurring window is in one passage.
3. Automata: passages are dealt into shards by their owner; each shard compiles one Aho-Corasick automaton over them, in
   which every word is one letter.
4. Streaming: the stretches of all documents go through the automata of the shards that have a passage of theirs. Words
   are compared there, so an occurrence is exact; every place outside the owner's own passage is removed.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import broadcast_if_small, cut, in_arrow
from .shingles import rolling, word_hashes

WINDOW, PHRASE = 20, 6
#: Words of a tile, words between the starts of a passage's tiles: each window holds exactly one whole tile.
TILE, STEP = WINDOW // 2, WINDOW - WINDOW // 2 + 1
#: Passages of a shard that may share a tile; beyond, the windows themselves go into the automaton.
SHARED = 8
#: Windows of a stretch, recurring windows of a shard, characters that one task streams through a shard.
STRETCH, SHARD_WINDOWS, STREAM_CHARS = 512, 50_000, 4 << 20
LAST = 2**63 - 1
UNKNOWN = "\0"  # a word that no passage of the shard has


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def selected(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the phrases that a text's windows select."""
    if len(hashes) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    runs = rolling(hashes, PHRASE)
    view = np.lib.stride_tricks.sliding_window_view(runs, WINDOW - PHRASE + 1)
    at = np.concatenate([view[i : i + 65536].argmin(1) + np.arange(i, min(len(view), i + 65536)) for i in range(0, len(view), 65536)])
    places = np.unique(at)
    return places, runs[places]


def covered(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in [start, stop) of any pair."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.clip(starts, 0, n), 1)
    np.add.at(step, np.clip(stops, 0, n), -1)
    return np.cumsum(step[:n]) > 0


def stretches_of(places: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last of each run of consecutive numbers, cut into runs of at most STRETCH."""
    breaks = np.nonzero(np.diff(places) > 1)[0]
    for a, b in zip(np.concatenate(([0], breaks + 1)).tolist(), np.concatenate((breaks, [len(places) - 1])).tolist()) if len(places) else ():
        for i in range(a, b + 1, STRETCH):
            yield int(places[i]), int(places[min(b, i + STRETCH - 1)])


def _keys() -> list[Column]:
    """A document's order (rows without id come last) and two hashes of its text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(7), "text").alias("d2")]


def phrase_table(docs: DataFrame) -> DataFrame:
    """Per row: doc, d1, d2, n_words, words_sha256 (all words joined by spaces), phrases (hashes of those selected), places (where they are)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, phrases, places = [], [], [], []
            for text in batch.column(3):
                words = split_words(text.as_py())
                at, values = selected(word_hashes(words))
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                phrases.append(values.view(np.int64))
                places.append(at.astype(np.int32))
            lists = [pa.array(phrases, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))]
            cols = [*(batch.column(i) for i in range(3)), pa.array(n, pa.int64()), pa.array(sha), *lists]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "d1", "d2", "n_words", "words_sha256", "phrases", "places"])

    schema = "doc long, d1 long, d2 long, n_words long, words_sha256 string, phrases array<bigint>, places array<int>"
    return in_arrow(docs.select(*_keys(), "text"), read, schema)


def stretch_table(texts: DataFrame) -> DataFrame:
    """texts (doc, d1, places, text) -> doc, d1, start, words, windows, repeats: the stretches around recurring phrases.

    windows: a hash of each window of the stretch, null where the document has had that window before; repeats: the
    hashes of those.
    """
    names, longs = ["doc", "d1", "start", "words", "windows", "repeats"], pa.list_(pa.int64())
    types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), longs, longs]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, d1, places, text in zip(*(batch.column(i) for i in range(4))):
                words = split_words(text.as_py())
                hits = np.array(places.as_py(), np.int64)
                runs = list(stretches_of(np.nonzero(covered(hits - (WINDOW - PHRASE), hits + 1, len(words) - WINDOW + 1))[0]))
                windows = np.concatenate([rolling(word_hashes(words[a : b + WINDOW]), WINDOW) for a, b in runs])
                first = np.zeros(len(windows), bool)
                first[np.unique(windows, return_index=True)[1]] = True
                at = 0
                for a, b in runs:
                    values, new = windows[at : at + b - a + 1].view(np.int64), first[at : at + b - a + 1]
                    at += b - a + 1
                    said = b" ".join(words[a : b + WINDOW]).decode("utf-8", "replace")
                    rows.append((doc.as_py(), d1.as_py(), a, said, pa.array(values, mask=~new), np.unique(values[~new])))
                if len(rows) > 500:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    schema = "doc long, d1 long, start int, words string, windows array<bigint>, repeats array<bigint>"
    return in_arrow(texts.select("doc", "d1", "places", "text"), read, schema)


def agree(a: str, i: int, b: str, j: int, most: int, step: int) -> int:
    """How many letters, at most ``most``, agree behind place i of a and place j of b (step 1), or before them (step -1)."""
    n = min(most, i, j) if step < 0 else min(most, len(a) - i, len(b) - j)
    if (a[i - n : i] == b[j - n : j]) if step < 0 else (a[i : i + n] == b[j : j + n]):
        return n
    k, back = 0, step < 0
    while k < n and a[i + k * step - back] == b[j + k * step - back]:
        k += 1
    return k


class Shard:
    """The passages of one shard and their automaton.

    passages: (doc, d1, start in the document, words). An automaton of all their windows would be twenty times as large
    as the passages; their tiles do, as every window holds exactly one tile of its passage. Where a tile is in more than
    SHARED passages, the windows around it go in whole, so that an occurrence never stands for many passages.
    """

    def __init__(self, passages: list[tuple[int, int, int, bytes]]):
        self.letters: dict[bytes, str] = {}
        self.passages = [(doc, d1, start, self._spell(words.split())) for doc, d1, start, words in passages]
        tiles: dict[str, list[tuple[int, int]]] = {}
        for i, (_, _, _, p) in enumerate(self.passages):
            for at in range(0, len(p) - TILE + 1, STEP):
                tiles.setdefault(p[at : at + TILE], []).append((i, at))
        patterns: dict[str, list[tuple[int, int]]] = {}
        for tile, places in tiles.items():
            if len(places) <= SHARED:
                patterns[tile] = places
                continue
            for i, at in places:
                p = self.passages[i][3]
                for start in range(max(0, at - STEP + 1), min(at, len(p) - WINDOW) + 1):
                    patterns.setdefault(p[start : start + WINDOW], []).append((i, start))
        self.places = list(patterns.values())
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for n, pattern in enumerate(patterns):
            self.automaton.add_word(pattern, 2 * n + (len(pattern) == WINDOW))
        if patterns:
            self.automaton.make_automaton()

    def _spell(self, words: list[bytes]) -> str:
        """Each word as one letter, from code point 1 on without surrogates."""
        known = self.letters
        return "".join([known.get(w) or known.setdefault(w, chr(n if (n := len(known) + 1) < 0xD800 else n + 0x800)) for w in words])

    def locate(self, doc: int, d1: int, start: int, words: list[bytes]) -> tuple[list[int], list[int]]:
        """Where the words of a stretch are in a passage, as starts and stops in the document; the owner's own place of a passage is left out.

        Passages that could only add words that are found already are not compared.
        """
        starts: list[int] = []
        stops: list[int] = []
        since = until = 0  # the last run found
        if not self.places:
            return starts, stops
        get = self.letters.get
        text = "".join([get(w, UNKNOWN) for w in words])
        size = len(text)
        for end, code in self.automaton.iter(text):
            n = WINDOW if code & 1 else TILE
            q = end - n + 1
            wide = WINDOW - n
            for i, at in self.places[code >> 1]:
                if since <= max(0, q - wide) and min(size, end + 1 + wide) <= until:
                    break
                owner, own_d1, origin, p = self.passages[i]
                if doc < owner or doc == owner and (d1 != own_d1 or start + q == origin + at):
                    continue
                a, b = agree(p, at, text, q, wide, -1), agree(p, at + n, text, end + 1, wide, 1)
                if a + b >= wide:
                    first, behind = q - a, end + 1 + b
                    if starts and first <= until:  # both hold the pattern's end or touch: one run
                        since, until = min(since, first), max(until, behind)
                        starts[-1], stops[-1] = start + since, start + until
                    else:
                        since, until = first, behind
                        starts.append(start + since)
                        stops.append(start + until)
        return starts, stops


def shard_pieces(stretches: DataFrame) -> DataFrame:
    """stretches (doc, d1, start, words, own, shard, shards) -> shard, stream, doc, d1, start, words.

    own: which windows of the stretch are recurring and belong to its document; they become passages (stream 0) of
    ``shard``. The stretch itself goes to each of ``shards`` (stream 1).
    """
    names = ["shard", "stream", "doc", "d1", "start", "words"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, d1, start, text, own, home, away in zip(*(batch.column(i).to_pylist() for i in range(7))):
                words = text.split(" ")
                for a, b in stretches_of(np.sort(np.array(own, np.int64))):
                    rows.append((home, 0, doc, d1, start + a, " ".join(words[a : b + WINDOW])))
                rows += [(shard, 1, doc, d1, start, text) for shard in away]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    schema = "shard int, stream int, doc long, d1 long, start int, words string"
    return in_arrow(stretches.select("doc", "d1", "start", "words", "own", "shard", "shards"), read, schema)


def stream_shards(dealt: DataFrame) -> DataFrame:
    """dealt (shard, part, stream, doc, d1, start, words), sorted by the first three -> doc, d1, starts, stops: every occurrence of a passage."""
    names, ints = ["doc", "d1", "starts", "stops"], pa.list_(pa.int32())
    types = [pa.int64(), pa.int64(), ints, ints]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, passages, shard = None, [], None
        for batch in batches:
            rows = []
            for home, part, stream, doc, d1, start, text in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if (home, part) != now:
                    now, passages, shard = (home, part), [], None
                words = text.encode("utf-8", "surrogatepass")
                if not stream:
                    passages.append((doc, d1, start, words))
                    continue
                if shard is None:
                    shard = Shard(passages)
                starts, stops = shard.locate(doc, d1, start, words.split())
                if starts:
                    rows.append((doc, d1, starts, stops))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    columns = ["shard", "part", "stream", "doc", "d1", "start", "words"]
    return in_arrow(dealt.select(*columns), read, "doc long, d1 long, starts array<int>, stops array<int>")


def occurrences(stretches: DataFrame) -> DataFrame:
    """doc, d1, starts, stops: all places of recurring windows that are not the first place of the window, one row a document.

    A hot passage sends a stretch of each of its documents to one shard; such a shard is streamed in parts of about
    STREAM_CHARS, each with its own copy of the automaton.
    """
    places = stretches.select("doc", "id", F.posexplode("windows").alias("at", "window")).where("window is not null")
    repeats = stretches.select("doc", "id", F.lit(-1).alias("at"), F.explode("repeats").alias("window"))
    seen = places.unionByName(repeats)
    firsts = seen.groupBy("window").agg(F.count("*").alias("n"), F.min("doc").alias("first")).where("n > 1")
    firsts = cut(firsts.select("window", "first"), "recurring-windows")
    shards = max(1, math.ceil(firsts.count() / SHARD_WINDOWS))
    home = lambda doc: F.pmod(F.xxhash64(doc), F.lit(shards)).cast("int")
    own = (F.col("doc") == F.col("first")) & (F.col("at") >= 0)
    met = seen.join(firsts, "window").groupBy("id").agg(F.collect_list(F.when(own, F.col("at"))).alias("own"), F.collect_set(F.when(~own, home("first"))).alias("shards"))
    met = stretches.drop("windows", "repeats").join(cut(met, "recurring-places"), "id").withColumn("shard", home("doc"))
    pieces = cut(shard_pieces(met), "pieces")
    parts = pieces.where("stream = 1").groupBy("shard").agg(F.ceil(F.sum(F.length("words")) / STREAM_CHARS).cast("int").alias("parts"))
    pieces = pieces.join(broadcast_if_small(cut(parts, "parts"), 24), "shard")
    spread = F.when(F.col("stream") == 0, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc", "d1", "start"), F.col("parts")).cast("int")))
    dealt = pieces.withColumn("part", F.explode(spread)).repartition("shard", "part").sortWithinPartitions("shard", "part", "stream")
    found = cut(stream_shards(dealt), "occurrences")
    return found.groupBy("doc", "d1").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("stops")).alias("stops"))


def remove_runs(texts: DataFrame) -> DataFrame:
    """texts (doc, d1, starts, stops, text) -> doc, d1, n_removed, kept: without the words in [start, stop) of any pair."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept = [], []
            for starts, stops, text in zip(*(batch.column(i) for i in range(2, 5))):
                words = split_words(text.as_py())
                out = covered(np.array(starts.as_py(), np.int64), np.array(stops.as_py(), np.int64), len(words))
                removed.append(int(out.sum()))
                kept.append(b" ".join([w for w, x in zip(words, out.tolist()) if not x]).decode("utf-8", "replace"))
            cols = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "d1", "n_removed", "kept"])

    return in_arrow(texts.select("doc", "d1", "starts", "stops", "text"), read, "doc long, d1 long, n_removed long, kept string")


def repeated_passages(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The parts of the result: all rows (doc, d1, d2, n_words, words_sha256), changed texts (doc, d1, n_removed, kept), copies (doc, d1, d2).

    Copies have the text of an earlier document, so all their windows start earlier; they are left out of the search,
    which loses nothing, as that earlier document is in it.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError(f"doc_id has to be of an integer type, not {docs.schema['doc_id'].dataType.simpleString()}")
    rows = cut(phrase_table(docs), "phrases")
    first = rows.groupBy("d1", "d2").agg(F.min("doc").alias("first"))
    later = rows.select("doc", "d1", "d2").join(cut(first, "first"), ["d1", "d2"]).where("doc > first").select("doc", "d1", "d2")
    copies = cut(cut(later, "later").distinct(), "copies")  # apart, so that Spark may split the join's hot partitions
    single = rows.select("doc", "d1", "d2", "phrases", "places").join(broadcast_if_small(copies, 48), ["doc", "d1", "d2"], "left_anti")
    counts = single.select(F.explode("phrases").alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"))
    recurring = cut(counts.where("n > 1").select("phrase"), "recurring")
    meets = single.select("doc", "d1", F.inline(F.arrays_zip("phrases", "places")).alias("phrase", "place")).join(recurring, "phrase")
    known = cut(meets.groupBy("doc", "d1").agg(F.collect_list("place").alias("places")), "known")

    texts = docs.select(*_keys(), "text").drop("d2")
    single_rows = rows.groupBy("doc", "d1").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    once = (lambda df: df) if single_rows else (lambda df: df.dropDuplicates(["doc", "d1"]))  # rows that are repeated are rare, and texts are long to sort
    stretches = cut(stretch_table(once(texts.join(known, ["doc", "d1"]))).withColumn("id", F.monotonically_increasing_id()), "stretches")
    found = cut(occurrences(stretches), "found")
    ids = broadcast_if_small(found.select("doc", "d1"), 48)
    changed = once(remove_runs(texts.join(ids, ["doc", "d1"], "left_semi").join(found, ["doc", "d1"])))
    return rows.select("doc", "d1", "d2", "n_words", "words_sha256"), changed, copies


def deduplicated_words(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, n_removed, kept_sha256 (the kept words joined by one space).

    Words are runs of other than ASCII white space; a window is WINDOW words. Each word is removed that lies in a window
    which also starts in a document with a smaller doc_id, or earlier in the same text. Null and short texts have no
    windows. Rows that share doc_id and text get equal results and do not remove each other; rows without doc_id come
    last in order. doc_id must be of an integer type. What is removed was found word for word by an automaton; hashes of windows (64 bits) only choose what
    the automata hold. Exact copies of thousands and hot phrases are counted before any shuffle by key; joins on a hot
    phrase are skewed joins that Spark splits.
    """
    rows, changed, copies = repeated_passages(docs)
    changed = changed.select("doc", "d1", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    gone = copies.withColumn("copy", F.lit(True))
    out = rows.join(changed, ["doc", "d1"], "left").join(gone, ["doc", "d1", "d2"], "left")
    whole = F.col("copy").isNotNull() & (F.col("n_words") >= WINDOW)
    return out.select(
        F.when(F.col("doc") != LAST, F.col("doc")).alias("doc_id"),
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "words_sha256")).alias("kept_sha256"),
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated words taken out of text; texts without repeats stay as they are, white space included.

    A column n_chars, if there is one, follows the text where it changes.
    """
    _, changed, copies = repeated_passages(docs)
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *_keys())
    gone = copies.withColumn("copy", F.lit(True))
    out = row.join(broadcast_if_small(gone, 48), ["doc", "d1", "d2"], "left").join(changed.drop("n_removed"), ["doc", "d1"], "left")
    short = F.size(F.array_remove(F.split("row.text", r"[\x20\x09-\x0D]+"), "")) < WINDOW
    new = F.when(F.col("copy").isNotNull() & ~short, F.lit("")).otherwise(F.col("kept"))
    cols = {c: F.col(f"row.`{c}`") for c in names}
    cols["text"] = F.coalesce(new, "row.text")
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        cols["n_chars"] = F.when(new.isNull(), F.col("row.n_chars")).otherwise(F.length(new).cast(kind))
    return out.select(*[e.alias(c) for c, e in cols.items()])
