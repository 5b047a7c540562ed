"""Sharding in Hilbert order: quantise metadata, sort by the curve's index, cut equal runs.

All of it is DataFrame work: no Python runs on the executors.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, named, ranked


def text_code(value: Column, skip: int = 0) -> Column:
    """A string as an integer in the same order: six of its bytes behind the first ``skip``; null sorts first."""
    code = F.conv(F.rpad(F.substring(F.hex(value), 2 * skip + 1, 12), 12, "0"), 16, 10).cast("long")
    return F.coalesce(code, F.lit(-1).cast("long"))


def common_bytes(df: DataFrame, columns: list[str]) -> list[int]:
    """How many leading bytes all values of each string column share: those of the smallest and the largest."""
    row = df.agg(*[f(named(c)).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("a", F.min), ("b", F.max))]).first()
    pairs = [((row[f"a{i}"] or "").encode(), (row[f"b{i}"] or "").encode()) for i in range(len(columns))]
    return [len(os.path.commonprefix(p)) if p[0] != p[1] else 0 for p in pairs]


def quantised(df: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """Replace each integer column of dims by its equi-depth cell, 0 to 2**bits - 1. The cell limits come from all rows."""
    cells = 2**bits
    points = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    row = df.agg(*[F.percentile_approx(d, points, 2000).alias(d) for d in dims]).first()
    for d in dims:
        limits = row[d] or []
        cell = F.lit(0)
        for x in limits:
            cell = cell + (F.col(d) > F.lit(x)).cast("int")
        df = df.withColumn(d, cell)
    return df


def curve_index(point: list[int], bits: int) -> int:
    """The Hilbert curve's index of a point with coordinates below 2**bits.

    The coordinates are turned into the curve's transposed form, one bit and one axis at a time (exchange or invert the
    lower bits), then Gray-coded and interleaved.
    """
    x = list(point)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(len(x)):
            if x[i] & bit:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = 0
    for level in range(bits - 1, 0, -1):
        if x[-1] >> level & 1:
            turn ^= (1 << level) - 1
    index = 0
    for level in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | (v ^ turn) >> level & 1
    return index


def hilbert_index(dims: list[str], bits: int) -> Column:
    """The curve's index of the cell columns dims, looked up in a constant array of 2**(bits * dims) entries."""
    cells = 2 ** (bits * len(dims))
    if cells > 1 << 16:
        raise ValueError("at most 2**16 cells: fewer bits or dimensions")
    table = [curve_index([c >> bits * i & (1 << bits) - 1 for i in range(len(dims))], bits) for c in range(cells)]
    at = F.lit(1)
    for i, d in enumerate(dims):
        at = at + F.col(d) * (1 << bits * i)
    return F.element_at(F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>"), at.cast("int"))


def hilbert_shards(
    df: DataFrame, dims: dict[str, Column], keep: list[str], order: list[str], shards: int = 24, bits: int = 4
) -> DataFrame:
    """Deal rows into shards 0 to shards - 1 whose row counts are at most one apart, in Hilbert order of dims.

    dims: name -> integer expression, at least two. keep: columns to return. order: columns of keep that tell rows
    apart; they settle the order inside one curve cell. Returns keep, ``curve`` (the index), ``shard`` and ``slot``
    (gapless from 0 in each shard). Nulls in a dimension should be mapped by its expression. An empty df gives no rows;
    with fewer rows than shards the first shards get one row each. A curve cell that holds most rows is ranked in
    hash buckets, never in one task.
    """
    axes = {f"_d{i}": e for i, e in enumerate(dims.values())}
    flat = cut(df.select(*map(named, keep), *[e.cast("long").alias(a) for a, e in axes.items()]), "curve")
    total = flat.count()
    placed = quantised(flat, list(axes), bits).select(*map(named, keep), hilbert_index(list(axes), bits).alias("curve"))
    small, extra = divmod(total, shards)
    wide = F.lit(extra * (small + 1))
    rank, over = F.col("rank"), F.col("rank") - F.lit(extra * (small + 1))
    base = max(small, 1)
    first = rank < wide
    return (
        ranked(placed, "curve", order, total)
        .withColumn("shard", F.when(first, F.floor(rank / (small + 1))).otherwise(extra + F.floor(over / base)).cast("int"))
        .withColumn("slot", F.when(first, rank % (small + 1)).otherwise(over % base).cast("long"))
        .select(*map(named, keep), "curve", "shard", "slot")
    )


def shard_documents(documents: DataFrame, shards: int = 24, keep: tuple[str, ...] = ()) -> DataFrame:
    """Documents dealt by (lang, source, size): doc_id, size, text_crc32, law, shard, slot, grown_shard, curve, and the columns of keep.

    Null text counts as empty (size 8); null lang or source sorts first. What all langs, or all sources, begin with does
    not count for their order. Repeated rows are dealt one by one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lang, source = common_bytes(documents, ["lang", "source"])
    flat = documents.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        text_code(F.col("lang"), lang).alias("lang_code"),
        text_code(F.col("source"), source).alias("source_code"),
        *[named(c) for c in keep],
    )
    dims = {"lang": F.col("lang_code"), "source": F.col("source_code"), "size": F.col("size")}
    out = hilbert_shards(flat, dims, ["doc_id", "size", "text_crc32", *keep], ["text_crc32", "doc_id"], shards)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve", *[named(c) for c in keep]
    )


def write_shards(dealt: DataFrame, path: str, shards: int = 24, files: int = 4) -> None:
    """One folder per shard with about ``files`` files in slot order: where dealt keeps the dimensions (see keep), a reader skips the files whose statistics exclude its filter."""
    dealt.repartitionByRange(shards * files, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
