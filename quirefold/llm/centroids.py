"""Centroid clustering (k-means in integers) by way of a vector approximation file.

Each vector is also stored as an approximation: BITS bits per dimension, the number of the cell that the component lies
in. Most of a round reads the approximations only. A table with an entry for each dimension and cell gives, for two
centroids, the least that the distance to one can exceed the distance to the other by; the vector's own square cancels,
so these intervals are several times as narrow as those of the two distances. Where the intervals leave one centroid,
the vector is decided; only where they overlap, or where the centroid changes, the full vector is fetched.

Sums of clusters are kept from round to round: a round adds what moves from one cluster to another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import broadcast_if_small, cut, in_arrow, named

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED, BITS = 64, 8, 10, 1024, 3, 6
#: Vectors whose components place the borders of the cells: any borders give the same result.
SAMPLE = 4096
#: Components beyond count as this, so that squared distances fit 64 bits.
LARGEST = 1 << 27


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component as a double, within LARGEST."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x.cast("double") * scale))).cast("int"))


def usable(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & F.forall(vector, lambda x: F.coalesce(finite(x), F.lit(False))), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of equal length as a matrix of 64-bit integers."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the first of equals, and the squared distance; exact."""
    out = np.zeros((len(vectors), len(centroids)), np.int64)
    for j, c in enumerate(centroids):
        for at in range(0, len(vectors), 8192):
            part = vectors[at : at + 8192] - c
            out[at : at + 8192, j] = np.einsum("ij,ij->i", part, part)
    cluster = out.argmin(1)
    return cluster, out[np.arange(len(out)), cluster]


class Cells:
    """The cells of each dimension: cell i of dimension d holds the integers from low[d, i] to high[d, i]."""

    def __init__(self, sample: np.ndarray, bits: int = BITS):
        self.bits, n = bits, 1 << bits
        ordered = np.sort(sample, 0)
        #: the first value of cells 1, 2, ...: borders of equal numbers of sample values
        self.starts = ordered[np.arange(1, n) * len(ordered) // n].T.copy()
        self.low = self.high = np.zeros((0, 0), np.int64)

    def bound(self, least: np.ndarray, most: np.ndarray) -> None:
        """Close the outer cells by the least and largest component of each dimension. An empty cell is low > high; it is never looked up."""
        self.low = np.concatenate([least[:, None], self.starts], 1)
        self.high = np.concatenate([self.starts - 1, most[:, None]], 1)

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Packed cell numbers, ``bits`` a dimension."""
        cells = np.stack([np.searchsorted(s, vectors[:, d], "right") for d, s in enumerate(self.starts)], 1).astype(np.uint8)
        return np.packbits(np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - self.bits :].reshape(len(cells), -1), axis=1)

    def decode(self, packed: np.ndarray) -> np.ndarray:
        n = len(self.starts)
        flags = np.unpackbits(packed, axis=1)[:, : n * self.bits].reshape(len(packed), n, self.bits)
        return np.packbits(np.concatenate([np.zeros((*flags.shape[:2], 8 - self.bits), np.uint8), flags], 2), axis=2)[:, :, 0]

    def decide(self, cells: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """The nearest centroid of each approximation, -1 where more than one can be nearest."""
        dims, middle = np.arange(len(self.starts)), self.low + self.high
        look = lambda table, of: sum(table[d][of[:, d]] for d in dims)
        guess = np.stack([look(c[:, None] * (c[:, None] - middle), cells) for c in centroids], 1).argmin(1)
        out = guess.copy()
        for b, near in enumerate(centroids):
            rows = np.nonzero(guess == b)[0]
            of = cells[rows]
            for j, far in enumerate(centroids):
                if j == b or not len(rows):
                    continue
                slope = 2 * (near - far)[:, None]
                excess = look(np.minimum(self.low * slope, self.high * slope) + (far * far - near * near)[:, None], of)  # at least this much farther
                out[rows[(excess < 0) | ((excess == 0) & (j < b))]] = -1
        return out


def approximations(vectors: DataFrame, cells: Cells) -> DataFrame:
    """vectors (row, v) -> row, cells."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = cells.encode(matrix(batch.column(1))) if len(batch) else np.zeros((0, 1), np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in packed], pa.binary())], names=["row", "cells"])

    return in_arrow(vectors.select("row", "v"), read, "row long, cells binary")


def to_fetch(approximate: DataFrame, cells: Cells, before: np.ndarray, now: np.ndarray) -> DataFrame:
    """row of the approximations whose full vectors a round needs: undecided, or decided to move."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            codes = cells.decode(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(batch), -1))
            new, old = cells.decide(codes, now), cells.decide(codes, before)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array((new < 0) | (old < 0) | (new != old)))], names=["row"])

    return in_arrow(approximate.select("row", "cells"), read, "row long")


def moves(vectors: DataFrame, before: np.ndarray | None, now: np.ndarray) -> np.ndarray:
    """What a round adds to the clusters: for each of them the change of the sums and, behind, of the count. Without ``before`` all vectors are new."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(0))
            if not len(v):
                continue
            new = nearest(v, now)[0]
            old = nearest(v, before)[0] if before is not None else np.full(len(v), -1)
            own = np.concatenate([v, np.ones((len(v), 1), np.int64)], 1)
            change = np.stack([own[(new == j) & (old != j)].sum(0) - own[(old == j) & (new != j)].sum(0) for j in range(len(now))])
            at = [i for i in range(len(now)) if change[i].any()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([change[i] for i in at], pa.list_(pa.int64()))], names=["cluster", "change"])

    parts = in_arrow(vectors.select("v"), read, "cluster int, change array<bigint>").select("cluster", F.posexplode("change").alias("d", "x"))
    out = np.zeros((len(now), now.shape[1] + 1), np.int64)
    for cluster, d, x in parts.groupBy("cluster", "d").agg(F.sum("x").alias("x")).collect():  # clusters x dimensions at most
        out[cluster, d] = x
    return out


def vector_table(table: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """row (a number of its own), key, v: the usable vectors in integers."""
    own = table.where(usable(named(vector), dimensions)).select(named(key).alias("key"), quantised(named(vector), scale).alias("v"))
    return cut(own.withColumn("row", F.monotonically_increasing_id()), "vectors")


def fit(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, bits: int = BITS, sample: int = SAMPLE, fetched: list[int] | None = None) -> np.ndarray:
    """The centroids after ``rounds`` rounds over vectors (row, key, v). ``fetched`` gets the number of full vectors of each round but the first."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    first = [r.v for r in vectors.orderBy(F.asc_nulls_last(order), "v").select("v").limit(max(sample, clusters)).collect()]
    if not first:
        return np.zeros((0, 0), np.int64)
    start = np.array(first, np.int64)
    centroids = start[:clusters].copy()
    cells = Cells(start, bits)
    n = start.shape[1]
    ends = vectors.agg(*[F.min(F.col("v")[d]) for d in range(n)], *[F.max(F.col("v")[d]) for d in range(n)]).first()
    cells.bound(np.array(ends[:n], np.int64), np.array(ends[n:], np.int64))
    approximate = cut(approximations(vectors, cells), "approximations") if rounds > 1 else None
    before, totals = None, np.zeros((len(centroids), n + 1), np.int64)
    for _ in range(rounds):
        if before is None:
            totals += moves(vectors, None, centroids)
        elif not np.array_equal(before, centroids):
            rows = cut(to_fetch(approximate, cells, before, centroids), "fetch")
            if fetched is not None:
                fetched.append(rows.count())
            totals += moves(vectors.join(broadcast_if_small(rows, 16), "row", "left_semi"), before, centroids)
        before, counts = centroids, totals[:, -1:]
        centroids = np.where(counts > 0, totals[:, :-1] // np.maximum(counts, 1), centroids)
    return centroids


def assigned(vectors: DataFrame, centroids: np.ndarray, key: str = "vec_id") -> DataFrame:
    """vectors (key, v) -> key, cluster, distance: the nearest centroid of each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(matrix(batch.column(1)), centroids) if len(batch) else (np.zeros(0), np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance.astype(np.int64))], names=[key, "cluster", "distance"])

    kind = vectors.schema["key"].dataType
    return in_arrow(vectors.select("key", "v"), read, StructType([StructField(key, kind), *StructType.fromDDL("cluster int, distance long").fields]))


def cluster_vectors(table: DataFrame, key: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED, bits: int = BITS) -> DataFrame:
    """Per usable vector: key, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Usable: ``dimensions`` components, none null, NaN or infinite; other rows are left out, other columns not read.
    Components become floor(scale * x); beyond +-2**27 they count as that. The first centroids are the vectors with the
    least sha256 of ``seed:key``, those of a null key last, equal ones by their components; fewer vectors than
    ``clusters`` give as many clusters. Means are rounded down; empty clusters stay; of equal distances the smaller
    number counts. Repeated rows count each. Sums that do not fit 64 bits are null. An empty table gives no rows.
    """
    vectors = vector_table(table, key, vector, dimensions, scale)
    centroids = fit(vectors, clusters, rounds, seed, bits)
    rows = cut(assigned(vectors, centroids, key), "assigned")
    whole = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(whole.alias("s")).collect()}  # one row a cluster
    fits = lambda x: x if x < 1 << 63 else None
    known = [(j, fits(s), fits(sum(sums.values())), hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, s in sums.items()]
    schema = StructType([StructField("cluster", rows.schema["cluster"].dataType), StructField("cluster_inertia", LongType()), StructField("inertia", LongType()), *StructType.fromDDL("centroid_sha256 string").fields])
    return rows.join(F.broadcast(table.sparkSession.createDataFrame(known, schema)), "cluster").select(named(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
