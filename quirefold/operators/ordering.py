"""Ranks over a whole table without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hash_rank(df: DataFrame, hashed: str, out: str = "rank", digits: int = 3) -> DataFrame:
    """Add the rank (from 0) of each row in the order of a column of hex digests.

    Digests are uniform, so their first digits cut the order into even ranges; only the counts of these (16 ** digits
    at most) meet in one task.
    """
    ranges = df.withColumn("_range", F.left(F.col(hashed), F.lit(digits)))
    sums = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(hashed)) - 1
    return ranges.withColumn("_row", within).join(F.broadcast(sums), "_range").withColumn(out, F.col("_from") + F.col("_row")).drop("_range", "_from", "_row")


def hash_running_total(df: DataFrame, hashed: str, amount: str, out: str = "before", digits: int = 3) -> DataFrame:
    """Add the sum of ``amount`` over all rows before each one in the order of a column of hex digests."""
    ranges = df.withColumn("_range", F.left(F.col(hashed), F.lit(digits)))
    sums = ranges.groupBy("_range").agg(F.sum(amount).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    within = F.coalesce(F.sum(amount).over(Window.partitionBy("_range").orderBy(hashed).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranges.withColumn("_sum", within).join(F.broadcast(sums), "_range").withColumn(out, F.col("_from") + F.col("_sum")).drop("_range", "_from", "_sum")


def steps(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Add _step and _tie, whose order is that of a numeric key, nulls last: about ``rows`` rows have both in common.

    Steps end at quantiles of the key. A key that ends several of them has many rows: these are dealt by a hash of the
    whole row. There are at most 32 * 32 steps, so beyond 1024 * rows rows each has more of them.
    """
    facts = df.agg(F.count(key).alias("n"), (F.count("*") - F.count(key)).alias("nulls")).first()
    many = min(1024, facts["n"] // rows)
    found = df.agg(F.percentile_approx(key, F.array(*[F.lit(i / (many + 1)) for i in range(1, many + 1)]), 20 * many)).first()[0] if many else []
    ends = sorted(set(found))
    hashed = F.xxhash64(*[f.name for f in df.schema if "map<" not in f.dataType.simpleString()])
    absent = F.col(key).isNull()
    at = F.lit(0)
    tie = F.lit(0).cast("long")
    if ends:
        kind = f"array<{df.schema[key].dataType.simpleString()}>"
        parts = [ends[i : i + 32] for i in range(0, len(ends), 32)]
        lasts = F.array(*[F.lit(part[-1]) for part in parts]).cast(kind)
        limits = F.array(*[F.array(*map(F.lit, part)).cast(kind) for part in parts])
        below = F.size(F.filter(lasts, lambda x: x < F.col(key)))
        inner = F.size(F.filter(F.get(limits, below), lambda x: x < F.col(key)))
        at = F.when(below == len(parts), F.lit(len(ends))).otherwise(below * 32 + inner)
        times = F.get(F.array(*[F.lit(found.count(x)) for x in ends]), F.col("_step"))
        is_end = F.get(F.get(limits, F.floor(F.col("_step") / 32).cast("int")), F.col("_step") % 32) == F.col(key)
        tie = F.when(is_end & (times > 1), 1 + F.pmod(hashed, times))
    tie = F.when(absent, F.pmod(hashed, F.lit(facts["nulls"] // rows + 1))).otherwise(F.coalesce(tie, F.lit(0)))
    return df.withColumn("_step", F.when(absent, F.lit(len(ends) + 1)).otherwise(at)).withColumn("_tie", tie)


def group_rank(df: DataFrame, group: str, key: str, out: str = "rank", rows: int = 4096) -> DataFrame:
    """Add the rank (from 0) of each row within its group, in the order of a numeric key; nulls last, and a null group is one.

    The key's range is cut into steps of about ``rows`` rows; their counts per group are summed up, so that a group that
    holds most rows is still ranked by many tasks.
    """
    cut = steps(df, key, rows)
    before = Window.partitionBy(group).orderBy("_step", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(group, "_step", "_tie").agg(F.count("*").alias("_n"))
    sums = sums.select(F.col(group).alias("_g"), F.col("_step").alias("_s"), F.col("_tie").alias("_t"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    within = F.row_number().over(Window.partitionBy(group, "_step", "_tie").orderBy(F.asc_nulls_last(key))) - 1
    on = F.col(group).eqNullSafe(F.col("_g")) & (F.col("_step") == F.col("_s")) & (F.col("_tie") == F.col("_t"))
    return cut.withColumn("_row", within).join(sums, on).withColumn(out, F.col("_from") + F.col("_row")).drop("_step", "_tie", "_from", "_row", "_g", "_s", "_t")
