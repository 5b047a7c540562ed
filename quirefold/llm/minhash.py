"""Near-duplicates by b-bit MinHash: bands of minima find candidates, packed low bits estimate, full sets decide."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import broadcast_if_small, cut, in_arrow
from .components import connected_components
from .shingles import mix, shingle_set

#: Minima per band, bands, low bits kept of each minimum. At a similarity of 0.85 all bands differ once in 10**8 pairs.
ROWS, BANDS, BITS = 3, 20, 4
#: Linked if 100 * intersection >= LINK * union; pairs estimated below CANDIDATE (six deviations less) are dropped.
LINK, CANDIDATE = 85, 0.55
#: Members of a block of a bucket; members and shingles of a block of a group. Larger ones are compared in block pairs.
BUCKET_BLOCK, BLOCK, BLOCK_SHINGLES = 512, 128, 200_000
#: What it costs to count and rank the shingles of a set, in copies of it.
COPIES = 12
_LANES = BITS * ROWS * BANDS // 60  # signature words of 60 bits: 15 minima of 4 bits each
_SEEDS = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (int64) and the low bits of all minima, packed 15 to a word, of a non-empty set."""
    least = np.full(len(_SEEDS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        least = np.minimum(least, mix(shingles[None, at : at + 4096] * _SEEDS[:, None]).min(1))
    keys = np.zeros(BANDS, np.uint64)
    for i in range(ROWS):
        keys = mix(keys + least[i::ROWS])
    keys = mix(keys + np.arange(BANDS, dtype=np.uint64))
    low = (least & np.uint64(15)).reshape(_LANES, 15)
    return keys.view(np.int64), (low << (np.arange(15, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64).view(np.int64)


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (rows against rows): equal minima by bit counts, less those equal by chance."""
    ones, chance, parts = np.uint64(0x111111111111111), 2.0**-BITS, []
    for at in range(0, len(a), 64):
        x = a[at : at + 64].view(np.uint64)[:, None, :] ^ b.view(np.uint64)[None, :, :]
        x = (x | x >> np.uint64(1) | x >> np.uint64(2) | x >> np.uint64(3)) & ones
        parts.append(1 - np.bitwise_count(x).sum(2, dtype=np.int64) / (ROWS * BANDS))
    return (np.concatenate(parts) - chance) / (1 - chance)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix, from the first members on: groups in the same order give the same edges again."""
    todo, edges = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not todo[root]:
            continue
        todo[root] = False
        front = [root]
        while front:
            i = front.pop()
            new = np.nonzero(linked[i] & todo)[0]
            todo[new] = False
            edges += [(i, int(j)) for j in new]
            front += new.tolist()
    return edges


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows with equal first ``keys`` columns, which must come one after another, as tables of one or more whole groups."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        key = [held.column(i).to_numpy() for i in range(keys)]
        differs = np.zeros(len(held), bool)
        for k in key:
            differs[1:] |= k[1:] != k[:-1]
        last = int(np.nonzero(differs)[0][-1]) if differs.any() else 0
        if last:
            yield held.slice(0, last)
            held = held.slice(last)
    if held is not None and len(held):
        yield held


def groups(table: pa.Table, keys: int) -> Iterator[tuple[int, int]]:
    """Start and end of each group in a table of runs()."""
    differs = np.zeros(len(table), bool)
    for i in range(keys):
        k = table.column(i).to_numpy()
        differs[1:] |= k[1:] != k[:-1]
    edges = [0, *np.nonzero(differs)[0].tolist(), len(table)]
    return zip(edges, edges[1:])


def shingle_table(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, set1 and set2 (a 128-bit digest of the set; null without words), bands, packed."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, one, two, bands, packed = [], [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py())
                n.append(len(s))
                if len(s):
                    keys, low = signature(s)
                    one.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                    two.append(int(np.bitwise_xor.reduce(mix(s * np.uint64(0xD6E8FEB86659FD93))).view(np.int64)))
                    bands.append(keys)
                    packed.append(low)
                else:
                    for c in (one, two, bands, packed):
                        c.append(None)
            longs = pa.list_(pa.int64())
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(bands, longs), pa.array(packed, longs)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "set1", "set2", "bands", "packed"])

    return in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), 
        sketch, "doc_id long, n_shingles long, set1 long, set2 long, bands array<bigint>, packed array<bigint>"
    )


def block_pairs(rows: DataFrame, blocks: str, keep: list[str]) -> DataFrame:
    """Send each row to every pair of blocks of its group that holds its own block: keep, low, high, own.

    blocks: the number of blocks of the row's group; a row's block is a hash of doc_id. A group of one block is sent once.
    """
    own = F.pmod(F.xxhash64("doc_id"), F.col(blocks)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col(blocks).cast("int") - 1))
    return rows.select(*keep, own.alias("own"), other.alias("other")).select(
        *keep, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own"
    )


def candidate_edges(reps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all pairs of one bucket with an estimate of CANDIDATE or more: a spanning forest of each block pair."""
    members = reps.select("doc_id", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = members.join(sizes, "band").join(reps.select("doc_id", "packed"), "doc_id")
    met = met.withColumn("blocks", F.ceil(F.col("n") / BUCKET_BLOCK))
    dealt = block_pairs(met, "blocks", ["band", "doc_id", "packed"]).select("band", "low", "high", "doc_id", "packed")
    dealt = dealt.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "doc_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, 3):
            ids = table.column(3).to_numpy()
            packed = np.stack(table.column(4).to_numpy()).astype(np.int64)
            a, b = [], []
            for start, end in groups(table, 3):
                for i, j in forest(estimates(packed[start:end], packed[start:end]) >= CANDIDATE) if end - start > 1 else ():
                    a.append(ids[start + i])
                    b.append(ids[start + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return in_arrow(dealt, compare, "a long, b long").distinct()


def linked_pairs(sets: list[np.ndarray], link: int = LINK) -> np.ndarray:
    """Which sets are linked with which, exactly. Shingles that only one set has are left out of the products."""
    n = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    common = count > 1
    column = np.cumsum(common) - 1
    at, owner = column[place[common[place]]], owner[common[place]]
    both = np.zeros((len(sets), len(sets)), np.float64)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    width = max(1, (1 << 21) // len(sets))
    for first in range(0, int(common.sum()), width):
        lo, hi = np.searchsorted(at, (first, first + width))
        has = np.zeros((len(sets), width), np.float32)
        has[owner[lo:hi], at[lo:hi] - first] = 1
        both += has @ has.T
    return 100 * both >= link * (n[:, None] + n[None, :] - both)


def set_table(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """doc_id, label, blocks, shingles (sorted) of the documents in placed (doc_id, label, blocks)."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 200) for i in range(0, batch.num_rows, 200)):
                sets = pa.array([shingle_set(x.as_py()).view(np.int64) for x in part.column(3)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), sets], names=["doc_id", "label", "blocks", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(broadcast_if_small(placed.select("doc_id", "label", "blocks"), 48), "doc_id")
    return in_arrow(texts.select("doc_id", "label", "blocks", "text"), shingle, "doc_id long, label long, blocks long, shingles array<bigint>")


def compared(rows: DataFrame, keys: list[str], link: int) -> DataFrame:
    """Edges (a, b) that connect all truly linked pairs among the rows (keys, doc_id, shingles) with equal keys: a spanning forest of each group."""
    n = len(keys)
    dealt = rows.select(*keys, "doc_id", "shingles").repartition(*keys).sortWithinPartitions(*keys, "doc_id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, n):
            ids, raw = table.column(n).to_numpy(), table.column(n + 1)
            a, b = [], []
            for start, end in groups(table, n):
                if end - start > 1:
                    sets = [raw[k].values.to_numpy().view(np.uint64) for k in range(start, end)]
                    for i, j in forest(linked_pairs(sets, link)):
                        a.append(ids[start + i])
                        b.append(ids[start + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return in_arrow(dealt, verify, "a long, b long")


def linked_only(pairs: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                one, two = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= link * (len(one) + len(two) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return in_arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y"), verify, "a long, b long")


def rare_shingles(sets: DataFrame, link: int) -> DataFrame:
    """label, token, doc_id: the prefix of each set in the order of rarity within its group, without tokens that only one set has.

    Two linked sets share ``link`` per cent of the larger one at least, so they meet in a token of their prefixes.
    """
    flat = sets.select("label", "doc_id", F.explode("shingles").alias("token"))
    counts = cut(flat.groupBy("label", "token").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    ordered = flat.join(counts, ["label", "token"], "left").groupBy("label", "doc_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "token"))).alias("s"))
    size = F.size("s")
    prefix = F.slice("s", F.lit(1), size - F.ceil(size * link / 100).cast("int") + 1)
    return ordered.select("label", "doc_id", F.explode(prefix).alias("x")).where("x.n > 1").select("label", F.col("x.token").alias("token"), "doc_id")


def open_groups(members: DataFrame, edges: DataFrame) -> DataFrame:
    """members (doc_id, label) with found, the smallest member that edges connect them to, of the groups that are not connected as a whole."""
    known = connected_components(edges).select(F.col("node").alias("doc_id"), F.col("label").alias("found"))
    named = cut(members.join(known, "doc_id", "left").select("doc_id", "label", F.coalesce("found", "doc_id").alias("found")), "named")
    still = named.groupBy("label").agg(F.min("found").alias("low"), F.max("found").alias("high")).where("low <> high").select("label")
    return cut(named.join(cut(still, "still"), "label").select("doc_id", "label", "found"), "open")


def large_group_links(sets: DataFrame, candidates: DataFrame, link: int) -> DataFrame:
    """Edges (a, b) that connect all linked pairs of groups that are too large to be compared at once.

    First the candidate edges, a few for each set, are verified; they connect near copies of one text in linear work,
    and groups that are one component then are done. The sets of the others meet by prefix tokens: every set is compared
    with the smallest one of each of its tokens, and where a token's sets are still not connected, with one another; a
    token of more than BLOCK sets in block pairs.
    """
    near = cut(linked_only(candidates, sets, link), "near")
    rest = open_groups(sets.select("doc_id", "label"), near)
    if rest.isEmpty():
        return near
    left = cut(sets.join(broadcast_if_small(rest.select("doc_id", "label"), 24), ["doc_id", "label"]), "open-sets")
    prefix = cut(rare_shingles(left, link), "prefixes")
    first = cut(prefix.groupBy("label", "token").agg(F.min("doc_id").alias("a"), F.count("*").alias("n")).where("n > 1"), "first")
    pairs = prefix.join(first, ["label", "token"]).where("doc_id <> a").select("a", F.col("doc_id").alias("b")).distinct()
    near = cut(near.unionByName(linked_only(cut(pairs, "pairs"), left, link)), "nearer")
    named = cut(prefix.join(open_groups(rest.select("doc_id", "label"), near), ["label", "doc_id"]), "tokens")
    still = named.groupBy("label", "token").agg(F.count("*").alias("n"), F.min("found").alias("low"), F.max("found").alias("high")).where("low <> high")
    rest = named.join(cut(still.select("label", "token", F.ceil(F.col("n") / BLOCK).alias("blocks")), "open"), ["label", "token"])
    rest = cut(block_pairs(rest, "blocks", ["label", "token", "doc_id"]).drop("own"), "rest")
    return near.unionByName(compared(rest.join(left.select("doc_id", "shingles"), "doc_id"), ["label", "token", "low", "high"], link))


def exact_links(docs: DataFrame, members: DataFrame, candidates: DataFrame, link: int) -> DataFrame:
    """Edges (a, b) that connect all truly linked pairs within each group of members (doc_id, n_shingles, label), which candidates (a, b) connect.

    A group goes in block pairs, which send each set once for each block, or by rare shingles, which costs about as much
    as COPIES of the set and one more for each token of its prefix: whichever sends less. So no group, however large,
    costs more than a bounded number of copies of its sets.
    """
    size = F.avg("n_shingles")
    blocks = F.greatest(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK))
    sums = members.groupBy("label").agg(blocks.alias("blocks"), (COPIES + size * (100 - link) / 100).alias("most"))
    placed = cut(members.select("doc_id", "label").join(cut(sums, "sizes"), "label"), "placed")
    dealt = block_pairs(set_table(docs, placed.where("blocks <= most")), "blocks", ["label", "doc_id", "shingles"])
    edges = compared(dealt, ["label", "low", "high"], link)
    large = placed.where("blocks > most")
    if not large.isEmpty():
        own = cut(candidates.join(broadcast_if_small(large.select(F.col("doc_id").alias("a")), 16), "a", "left_semi"), "own")
        edges = edges.unionByName(large_group_links(cut(set_table(docs, large).drop("blocks"), "large-sets"), own, link))
    return edges.distinct()


def near_duplicates(docs: DataFrame, link: int = LINK) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Two documents are linked if 100 * intersection >= link * union of their sets of five-word shingles (A-Z lower-cased;
    fewer words: the whole sequence). A text without words, or null, has an empty set and is linked with nothing.
    Rows of one doc_id are one document; with a null doc_id nothing is linked, component_id is null and kept is true.
    Equal sets are one node, so thousands of copies cost one comparison. Buckets of different sets give a spanning forest
    of their pairs only, and large groups are compared by rare shingles (see large_group_links): no pair list of a group
    is ever made. doc_id must be an integer column; another type is refused, as it could not be ordered as numbers. link:
    at least 80, for which the bands miss a pair with a chance of 6 in 10 million.
    """
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be of an integer type")
    if link < 80:
        raise ValueError("the bands are made for links of 80 per cent or more")
    table = cut(shingle_table(docs), "sketches")
    whole = table.where("set1 is not null and doc_id is not null")
    sets = cut(whole.groupBy("set1", "set2").agg(F.min("doc_id").alias("rep")), "sets")
    reps = sets.join(whole, ["set1", "set2"]).where("doc_id = rep").select("doc_id", "n_shingles", "bands", "packed").dropDuplicates(["doc_id"])
    reps = cut(reps, "reps")
    candidates = cut(candidate_edges(reps), "candidates")
    near = connected_components(candidates)
    members = cut(near.join(reps.select(F.col("doc_id").alias("node"), "n_shingles"), "node").select(F.col("node").alias("doc_id"), "n_shingles", "label"), "members")
    labels = connected_components(cut(exact_links(docs, members, candidates, link), "links"))
    named = sets.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("set1", "set2", F.coalesce("label", "rep").alias("found"))
    out = table.join(cut(named, "named"), ["set1", "set2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, link: int = LINK) -> DataFrame:
    """docs, in their own columns, without those of which a near-duplicate with a smaller doc_id stays."""
    gone = cut(near_duplicates(docs, link).where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(broadcast_if_small(gone, 16), "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
