"""Packing token sequences: linear grouping of the large lengths, an optimal mix of configurations, best fit for the small.

What is planned is the histogram of lengths, which has at most ``capacity`` entries however many documents there are.
The plan is a short table of runs; Spark ranks the pieces within their length and looks their place up in it.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, extended, in_arrow, ranked
from .tokens import ChunkIds

CAPACITY = 2048
#: Groups of equal cardinality for lengths over capacity / SMALL_PART; shorter ones fill gaps.
GROUPS, SMALL_PART = 128, 8
#: How near the linear programme comes to its optimum.
NEAR = 1e-4
_ids: dict[str, ChunkIds] = {}


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """Each document's token ids and a closing id 0, cut into pieces of ``capacity``: doc_id, piece, start, length, ids_crc32 (and ids, an array).

    Null text counts as empty: one piece with the id 0 alone. Repeated rows are kept one by one. path: a tokenizer with
    word ends (see ChunkIds), a .json file.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    wide = capacity * 4

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ids:
            _ids[path] = ChunkIds(path)
        encode = _ids[path]
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at in range(0, len(keys), 500):
                rows = []
                for key, raw in zip(keys[at : at + 500], encode([x or "" for x in batch.column(1).slice(at, 500).to_pylist()])):
                    raw += b"\0\0\0\0"
                    for k, i in enumerate(range(0, len(raw), wide)):
                        one = raw[i : i + wide]
                        rows.append((key, k, k * capacity, len(one) // 4, zlib.crc32(one), memoryview(one).cast("I").tolist() if ids else None))
                cols = [[r[i] for r in rows] for i in range(len(names))]
                types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    schema = "piece int, start long, length long, ids_crc32 long" + ", ids array<bigint>" * ids
    return in_arrow(docs.select("doc_id", "text"), pieces, extended(docs, ["doc_id"], schema))


def grouped(counts: dict[int, int], groups: int) -> dict[int, int]:
    """Lengths in falling order cut into groups of equal cardinality, each rounded up to its largest: rounded length -> pieces.

    Groups of one rounded length are one. No more lengths than groups stay as they are.
    """
    if len(counts) <= groups:
        return dict(sorted(counts.items(), reverse=True))
    per, out, size, held = -(-sum(counts.values()) // groups), {}, 0, 0
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not held:
                size, held = length, per
            k = min(n, held)
            out[size] = out.get(size, 0) + k
            held -= k
            n -= k
    return out


def fullest(sizes: list[int], prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most that sizes with these prices, each any number of times, are worth within capacity, and how many of each that takes."""
    best, steps = np.zeros(capacity + 1), []
    for s, price in zip(sizes, prices.tolist()):
        steps.append(best)
        if price > 1e-12:
            old, best = best, best.copy()
            for k in range(1, capacity // s + 1):
                np.maximum(best[k * s :], old[: capacity + 1 - k * s] + k * price, out=best[k * s :])
    take, room = np.zeros(len(sizes)), capacity
    for g in range(len(sizes) - 1, -1, -1):
        worth, old = best[room], steps[g]
        while old[room] + take[g] * prices[g] < worth - 1e-12 and room >= sizes[g]:
            take[g] += 1
            room -= sizes[g]
        best = old
    return float((take * prices).sum()), take


def configurations(sizes: list[int], need: list[int], capacity: int, rounds: int = 3000) -> list[tuple[list[int], int]]:
    """Configurations (sizes that share a sequence, falling) and how often each is used, over all groups at once.

    The linear programme of the fewest sequences that hold all pieces, by column generation: the simplex method on one
    configuration per group, to which the most valuable one at the current prices is added as long as there is one. The
    solution is rounded down; at any round it is a valid one, and at the end within NEAR of the best.
    """
    m, demand = len(sizes), np.array(need, float)
    fill = np.array([capacity // s for s in sizes], float)
    columns, inverse, times = np.diag(fill), np.diag(1 / fill), demand / fill
    for _ in range(rounds):
        value, column = fullest(sizes, inverse.sum(0), capacity)
        if value <= 1 + NEAR:
            break
        change = (inverse * column).sum(1)
        ratio = np.where(change > 1e-9, times / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = column
        times = np.maximum(0, times - ratio[out] * change)
        times[out] = ratio[out]
        pivot = inverse[out] / change[out]
        inverse = inverse - np.outer(change, pivot)
        inverse[out] = pivot
    found = [([s for s, k in zip(sizes, columns[:, j]) for _ in range(round(k))], math.floor(times[j] + 1e-6)) for j in range(m)]
    return sorted((f for f in found if f[1] and f[0]), reverse=True)


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first rank, how many, first sequence, pieces a sequence, first offset) that place all pieces.

    Within a run, pieces of one length go one after another into each sequence, ``pieces a sequence`` to each. Lengths
    over capacity / SMALL_PART follow configurations of rounded sizes; for each place in one, the longest remaining length
    is taken that leaves the later places their sizes, so that rounding leaves no gap that a piece could use. What the
    rounded-down solution leaves over, and all small lengths, go by best fit into the real gaps, longest first.
    """
    runs, used, bins = [], dict.fromkeys(counts, 0), 0
    left = {k: n for k, n in counts.items() if n}
    gaps: dict[int, list[tuple[int, int]]] = {}  # room -> [(first sequence, how many)]

    def put(length: int, n: int, first: int, per: int, offset: int) -> None:
        runs.append((length, used[length], n, first, per, offset))
        used[length] += n
        left[length] -= n

    if n := left.get(capacity, 0):
        put(capacity, n, 0, 1, 0)
        bins = n
    large = {k: n for k, n in left.items() if capacity // SMALL_PART < k < capacity}
    lengths = sorted(large)
    sizes = grouped(large, groups)
    for slots, times in configurations(list(sizes), list(sizes.values()), capacity) if sizes else ():
        while times:
            picked: list[int] = []
            kept = sum(slots)
            for s in slots:
                kept -= s
                i = bisect_right(lengths, capacity - sum(picked) - kept) - 1
                while i >= 0 and left[lengths[i]] <= picked.count(lengths[i]):
                    i -= 1
                if i >= 0:
                    picked.append(lengths[i])
            if sum(picked) < sum(slots):
                break
            step, offset = min(times, *(left[k] // picked.count(k) for k in picked)), 0
            for k in picked:
                put(k, step, bins, 1, offset)
                offset += k
            for k in set(picked):
                if not left[k]:
                    lengths.pop(bisect_left(lengths, k))
            gaps.setdefault(capacity - offset, []).append((bins, step))
            bins += step
            times -= step
    rooms = sorted(gaps)

    def leave(room: int, first: int, many: int) -> None:
        if many:
            if not gaps.get(room):
                gaps[room] = []
                insort(rooms, room)
            gaps[room].append((first, many))

    for length in sorted((k for k, n in left.items() if n), reverse=True):
        while n := left[length]:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                room, first, many = capacity, bins, -(-n // (capacity // length))
                bins += many
            else:
                room = rooms[i]
                first, many = gaps[room].pop()
                if not gaps[room]:
                    rooms.pop(i)
            per = room // length
            full = min(many, n // per)
            rest = min(per, n - full * per) if full < many else 0
            for at, k, each in ((first, full, per), (first + full, 1, rest)):
                if k and each:
                    put(length, k * each, at, each, capacity - room)
                    leave(room - each * length, at, k)
            leave(room, first + full + (rest > 0), many - full - (rest > 0))
    return runs


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Add sequence_id and offset to pieces (doc_id, piece, length, ...), each at most ``capacity`` long.

    Pieces of equal length are interchangeable; they are ranked in hash buckets by (doc_id, piece), so that one length
    may hold most rows. Only the histogram (at most ``capacity`` rows) goes to the driver, and the plan's runs, whose
    number follows from capacity and groups, are broadcast. No pieces give no rows.
    """
    spark = pieces.sparkSession
    flat = cut(pieces, "pieces")
    counts = {r["length"]: r["count"] for r in flat.groupBy("length").count().collect()}
    runs = spark.createDataFrame(plan(counts, capacity, groups), "length long, first long, many long, seq long, per long, at long")
    rows = ranked(flat, "length", ["doc_id", "piece", "ids_crc32"], sum(counts.values())).drop("rank").alias("p")
    on = "p.length = r.length and p.class_rank >= r.first and p.class_rank < r.first + r.many"
    nth = F.col("class_rank") - F.col("first")
    return rows.join(F.broadcast(runs.alias("r")), F.expr(on)).select(
        *[F.col(f"p.{c}").alias(c) for c in flat.columns],
        (F.col("seq") + F.floor(nth / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + (nth % F.col("per")) * F.col("p.length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """token_pieces(), then pack_pieces()."""
    return pack_pieces(token_pieces(docs, path, capacity), capacity, groups)
