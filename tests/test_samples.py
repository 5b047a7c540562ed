"""Shuffles that each row computes for itself, and splits of exact sizes."""

import pytest
from pyspark.sql import functions as F
from quirefold.operators import pages


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 16, 17, 100, 1023, 4099])
def test_places_are_a_permutation(spark, n):
    places = [[r[0] for r in spark.range(n).select(pages.permuted_place(F.col("id"), n, seed)).collect()] for seed in (1, 1, 2)]
    assert sorted(places[0]) == list(range(n)) and places[0] == places[1] and sorted(places[2]) == list(range(n))
    if n > 16:
        assert places[0] != places[2] and places[0] != list(range(n))


def test_places_look_shuffled(spark):
    n = 5000
    rows = spark.range(n).select("id", pages.permuted_place(F.col("id"), n, 7).alias("p")).toPandas()
    assert abs(rows.id.corr(rows.p)) < 0.05
    near = (rows.p.diff().abs() < n / 100).mean()
    assert 0.01 < near < 0.03
    assert 0.25 < (rows.p < n / 2)[: n // 2].mean() * 0.5 + 0.01 < 0.28


def test_splits_have_exact_sizes_and_share_no_content(spark):
    rows = spark.range(300).select("id", F.concat(F.lit("t"), F.col("id") % 211).alias("text"))
    sizes = {"train": 119, "validation": 30, "test": 50}
    got = pages.sample_splits(rows, "id", F.col("text"), sizes, 42)
    assert {r.split: r["count"] for r in got.groupBy("split").count().collect()} == sizes
    assert got.join(rows, "id").select("text").distinct().count() == 199 and got.agg(F.max("id")).first()[0] < 211
    assert sorted(r.place for r in got.collect()) == list(range(199))
    assert got.exceptAll(pages.sample_splits(rows.repartition(7), "id", F.col("text"), sizes, 42)).count() == 0
    with pytest.raises(ValueError, match="211 pages"):
        pages.sample_splits(rows, "id", F.col("text"), {"train": 212})
    plan = pages.permuted_place(F.col("id"), 10, 1)
    assert "Exchange" not in spark.range(10).select(plan)._jdf.queryExecution().executedPlan().toString()
