"""Committed exports and rows at physical places."""

import pytest
from pyspark.sql import functions as F
from quirefold.plans import reports
from quirefold.sources import files

SCHEMA = "k long, role string, v string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_batch_is_taken_once_and_aborted_files_are_not_read(spark, tmp_path):
    path = str(tmp_path / "set")
    df = spark.range(20).select(F.col("id").alias("k"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("role"), F.concat(F.lit("é\n"), "id").alias("v")).repartition(3)
    assert rows(files.read_export(spark, path, SCHEMA, "source_audit")) == []
    assert files.export_batch(df.where("k < 8"), path, "one:1") and not files.export_batch(df, path, "one:1")
    assert files.export_batch(df.where("k >= 8"), path, "two")

    def fails(batches):
        for b in batches:
            yield b
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        files.export_batch(df.mapInArrow(fails, df.schema), path, "three")
    df.write.json(f"{path}/data/stray")
    assert rows(files.read_export(spark, path, SCHEMA, "final_evaluation")) == rows(df)
    assert rows(files.read_export(spark, path, SCHEMA, "training_supervision", ["a"])) == rows(df.where("role = 'a'"))
    assert files.export_batch(df.where("k = 1"), path, "three") and files.read_export(spark, path, SCHEMA, "source_audit").count() == 21
    log = rows(spark.read.json(f"{path}/reads").select("purpose", F.coalesce(F.array_join("roles", ","), F.lit("-")), "count"))
    assert log == [("final_evaluation", "-", 20), ("source_audit", "-", 0), ("source_audit", "-", 21), ("training_supervision", "a", 10)]


def test_undeclared_purposes_bad_names_and_changed_files_are_refused(spark, tmp_path):
    path = str(tmp_path / "set")
    df = spark.createDataFrame([(1, "a", "x")], SCHEMA)
    with pytest.raises(ValueError, match="purpose"):
        files.read_export(spark, path, SCHEMA, "curiosity")
    with pytest.raises(ValueError, match="batch"):
        files.export_batch(df, path, "../up")
    assert not (tmp_path / "set").exists()
    files.export_batch(df, path, "one")
    part = next(p for p in (tmp_path / "set" / "data").glob("one-*/*.json") if p.stat().st_size)
    part.write_text(part.read_text().replace("x", "y"))
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="digest"):
        files.read_export(spark, path, SCHEMA, "source_audit")


def test_rows_at_places(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 1000, 1, 3).select("id", (F.col("id") * 2).alias("x"), F.lit("unread").alias("y")).write.option("parquet.block.size", "1024").parquet(path)
    names = [r[0] for r in spark.read.parquet(path).select("_metadata.file_name").distinct().sort("file_name").collect()]
    asked = spark.createDataFrame([(names[0], 0), (names[0], 332), (names[1], 5), (names[1], 5), (names[2], 999), ("none", 0), (None, 1), (names[2], None)], "file string, row long")
    got = sorted((tuple(r) for r in files.rows_at(spark, path, asked, ["id", "x"]).collect()), key=repr)
    assert sorted(r[2:] for r in got if r[2]) == [(True, 0, 0), (True, 332, 664), (True, 338, 676)]
    assert sum(not r[2] for r in got) == 4 and all(r[3] is None for r in got if not r[2])
    assert files.rows_at(spark, path, asked.where("false"), ["id"]).count() == 0
    plan = files.rows_at(spark, path, asked, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint" in plan and ",x:bigint" not in plan and "Window" not in plan and "Sort " not in plan


def test_files_of_an_export_are_small(spark, tmp_path):
    path = str(tmp_path / "set")
    df = spark.range(100).select(F.col("id").alias("k"), F.lit("a").alias("role"), F.repeat(F.lit("x"), (F.col("id") % 7 * 100).cast("int")).alias("v")).coalesce(1)
    assert files.export_batch(df, path, "rows", file_rows=30) and files.export_batch(df, path, "bytes", file_rows=30, file_bytes=4000)
    sizes = {r.batch: (r.n, r.most) for r in spark.read.json(f"{path}/manifest").groupBy("batch").agg(F.count("*").alias("n"), F.max("bytes").alias("most")).collect()}
    assert sizes["rows"][0] == 4 and sizes["rows"][1] > 4000 and sizes["bytes"][1] <= 4000
    assert len(list((tmp_path / "set" / "data").iterdir())) == 2
    assert rows(files.read_export(spark, path, SCHEMA, "source_audit")) == rows(df.union(df))


def test_places_go_on_through_the_parts_of_a_source(spark, tmp_path):
    d = spark.range(0, 300, 1, 3).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"))
    d.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in reports.rows_by_place(spark, str(tmp_path)).collect())
    assert got == [("documents.parquet", k, k < 300, k if k < 300 else None, "en" if k < 300 else None) for k in range(0, 299 + 61, 41)]
