"""What surrounds a neural reader: windows of words, decoding of span scores, pluggable readers (WIN-10, ML-02, ML-03, FIL-02)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let

#: Tokens a window holds and by how many the next one overlaps; tokens besides question and words; longest answer in tokens.
WINDOW, OVERLAP, SPECIAL, LONGEST = 512, 128, 4, 15


def window_count(n_question: Column, n_tokens: Column, size: int = WINDOW, overlap: int = OVERLAP) -> Column:
    """WIN-10: how many overlapping windows a page of n_tokens needs beside its question; at least one."""
    room = size - SPECIAL - n_question
    step = room - overlap
    return F.when(n_tokens <= room, F.lit(1)).when(step > 0, 1 + F.ceil((n_tokens - room) / step)).cast("long")


def windows(pages: DataFrame, key: str, n_question: Column, n_tokens: Column, size: int = WINDOW, overlap: int = OVERLAP, keep: list[str] | None = None) -> DataFrame:
    """WIN-10: key, window, start, stop (exclusive) of every window of positions, and the columns ``keep``; the last one ends with the page."""
    room = size - SPECIAL - n_question
    n = F.greatest(window_count(n_question, n_tokens, size, overlap), F.lit(1)).cast("int")
    kept = keep or []
    rows = pages.select(key, *kept, room.alias("room"), n_tokens.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("window"))
    start = F.col("window") * (F.col("room") - overlap)
    return rows.select(key, "window", start.cast("long").alias("start"), F.least(start + F.col("room"), F.col("n")).cast("long").alias("stop"), *kept)


def softmax(logits: Column, allowed: Column | None = None) -> Column:
    """Probabilities of an array of logits. Places that are not ``allowed`` have none; nulls if no place is."""

    def spread(x: Column, top: Column) -> Column:
        weights = F.transform(x, lambda v: F.coalesce(F.exp(v - top), F.when(top.isNotNull(), 0.0)))
        return let(weights, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(e, lambda v: v / total)))

    shown = logits if allowed is None else F.zip_with(logits, allowed, lambda v, ok: F.when(ok, v))
    return let(shown, lambda x: let(F.array_max(x), lambda top: spread(x, top)))


def best_span(start: Column, end: Column, longest: int = LONGEST, allowed: Column | None = None) -> Column:
    """ML-02: struct(answer_start, answer_end, score) from arrays of start and end logits.

    The span with the largest product of the two softmax values, at most ``longest`` positions wide; the lowest start,
    then the lowest end, wins ties; an answer starts and ends where ``allowed`` is true. Per start only the best end is kept, so the work is linear in the window.
    """

    def pick(p: Column, q: Column) -> Column:
        score = F.transform(p, lambda v, i: v * F.array_max(F.slice(q, i + 1, longest)))
        return let(score, lambda s: let(F.array_max(s), lambda top: let((F.array_position(s, top) - 1).cast("int"), lambda at: place(q, top, at))))

    def place(q: Column, top: Column, at: Column) -> Column:
        near = F.slice(q, at + 1, longest)
        to = (at + F.array_position(near, F.array_max(near)) - 1).cast("int")
        return F.struct(at.alias("answer_start"), to.alias("answer_end"), top.alias("score"))

    return let(softmax(start, allowed), lambda p: let(softmax(end, allowed), lambda q: pick(p, q)))


def decode_span(rows: DataFrame, key: str, start: Column, end: Column, longest: int = LONGEST) -> DataFrame:
    """ML-02: key, answer_start, answer_end, score of each row."""
    return rows.select(key, best_span(start, end, longest).alias("b")).select(key, "b.*")


def decode_windows(rows: DataFrame, key: str, longest: int = LONGEST) -> DataFrame:
    """ML-02: rows (key, window, start_logits, end_logits, allowed, word_ids) -> key, start, end, score, n_windows: the best span of all windows of a key, in words.

    allowed: which tokens belong to the page. The greatest score wins, of equal ones that of the first window. start, end
    and score are null if no window has a span of page tokens with a score above zero.
    """
    own = rows.select(key, "window", "word_ids", best_span(F.col("start_logits"), F.col("end_logits"), longest, F.col("allowed")).alias("b"))
    found = F.struct(F.get("word_ids", F.col("b.answer_start")).alias("start"), F.get("word_ids", F.col("b.answer_end")).alias("end"), F.col("b.score").alias("score"))
    own = own.select(key, "window", found.alias("f"))
    good = (F.col("f.score") > 0) & F.col("f.start").isNotNull() & F.col("f.end").isNotNull()
    best = F.max_by(F.when(good, F.col("f")), F.when(good, F.struct(F.col("f.score"), -F.col("window"))))
    return own.groupBy(key).agg(best.alias("f"), F.count("*").alias("n_windows")).select(key, "f.start", "f.end", "f.score", "n_windows")


def read_answers(pages: DataFrame, key: str, reader: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """ML-03: run a reader over pages (key, question, words): key, start, end, score, n_windows, answer.

    reader maps a frame of question and words to one of start, end, score and n_windows in the same order; it is called
    on Arrow batches, so a model is loaded once per worker if the callable caches it. Spans outside the page are refused.
    """
    kind = pages.schema[key].dataType.simpleString()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = reader(frame[["question", "words"]]).reset_index(drop=True)
            out.insert(0, key, frame[key].to_numpy())
            n = frame["words"].map(len).to_numpy()
            if ((out["start"] < -1) | (out["end"] < out["start"]) | (out["end"] >= n)).any():
                raise ValueError("the reader returned a span outside its page")
            out["answer"] = [" ".join(w[s : e + 1]) if s >= 0 else "" for w, s, e in zip(frame["words"], out["start"], out["end"])]
            yield out[[key, "start", "end", "score", "n_windows", "answer"]]

    return pages.select(key, "question", "words").mapInPandas(read, f"`{key}` {kind}, start int, end int, score double, n_windows int, answer string")


def hashed_reader(frame: pd.DataFrame) -> pd.DataFrame:
    """A deterministic stand-in for a model: a word chosen by a checksum of question and page."""
    import zlib

    picks = [zlib.crc32(f"{q}|{len(w)}".encode()) for q, w in zip(frame["question"], frame["words"])]
    at = [p % len(w) if len(w) else -1 for p, w in zip(picks, frame["words"])]
    return pd.DataFrame({"start": at, "end": at, "score": [p % 1000 / 1000 for p in picks], "n_windows": 1})


def check_fit(pages: DataFrame, n_question: Column, n_tokens: Column) -> tuple[DataFrame, DataFrame]:
    """FIL-02: the rows that fit one window with their question, and those that need more; both with n_windows. Nothing is cut short."""
    counted = pages.withColumn("n_windows", window_count(n_question, n_tokens))
    return counted.where("n_windows = 1"), counted.where("n_windows <> 1 or n_windows is null")


def token_span(word_ids: Column, start: Column, end: Column) -> Column:
    """ML-07: struct(first_token, last_token) of the words start to end; word_ids has the word of each token, null for special ones. Nulls if none is there."""
    places = F.filter(F.transform(word_ids, lambda w, i: F.when((w >= start) & (w <= end), i)), lambda i: i.isNotNull())
    return let(places, lambda p: F.struct(F.array_min(p).alias("first_token"), F.array_max(p).alias("last_token")))
