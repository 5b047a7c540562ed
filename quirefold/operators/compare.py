"""Comparing runs, systems and variants of one input (FIL-04, AGG-04, AGG-13, EXP-*, RPL-01, JON-17, PRJ-09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import close
from ..functions.text import normalize_answer, spreadsheet_safe


def disagreements(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """FIL-04: keys, first, second where two systems' normalised answers differ."""
    both = a.select(*keys, F.col(value).alias("first")).join(b.select(*keys, F.col(value).alias("second")), keys)
    return both.where(normalize_answer(F.col("first")) != normalize_answer(F.col("second")))


def stability(rows: DataFrame, by: str, before: Column, after: Column) -> DataFrame:
    """AGG-13, EXP-02: per group how many answers stay the same, normalised, under a changed input: n, same, rate."""
    same = normalize_answer(before) == normalize_answer(after)
    return rows.groupBy(by).agg(F.count("*").alias("n"), F.count_if(same).alias("same"), F.avg(same.cast("int")).alias("rate"))


def deltas(rows: DataFrame, by: str, before: Column, after: Column) -> DataFrame:
    """AGG-04, EXP-01: mean of a score before and after a change, and the difference, per group."""
    return rows.groupBy(by).agg(F.avg(before).alias("before"), F.avg(after).alias("after")).withColumn("delta", F.col("after") - F.col("before"))


def replay_differences(first: DataFrame, second: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """RPL-01, NUM-02: keys, field, first, second where a second run is outside tolerance or has or lacks the row."""
    b = second.select(*keys, *[F.col(v).alias(f"_{v}") for v in values], F.lit(True).alias("_has"))
    both = first.withColumn("_had", F.lit(True)).join(b, keys, "full_outer")
    cells = [F.struct(F.lit(v).alias("field"), F.col(v).cast("double").alias("first"), F.col(f"_{v}").cast("double").alias("second")) for v in values]
    flat = both.select(*keys, "_had", "_has", F.explode(F.array(*cells)).alias("c")).select(*keys, "_had", "_has", "c.*")
    return flat.where(F.col("_had").isNull() | F.col("_has").isNull() | ~close(F.col("first"), F.col("second"))).drop("_had", "_has")


def upsert(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """JON-17: all rows of the keys in new are replaced by the rows of new."""
    return rows.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def wide(rows: DataFrame, key: list[str], field: str, fields: list[str], values: list[str]) -> DataFrame:
    """PRJ-09: one row per key with columns {field}_{value}, safe for spreadsheets."""
    cells = [F.max(F.when(F.col(field) == f, F.col(v))).alias(f"{f}_{v}") for f in fields for v in values]
    out = rows.groupBy(*key).agg(*cells)
    return out.select(*key, *[(spreadsheet_safe(F.col(f"{f}_{v}")) if dict(rows.dtypes)[v] == "string" else F.col(f"{f}_{v}")).alias(f"{f}_{v}") for f in fields for v in values])
