import glob
import zlib
from collections import Counter

import pyarrow.parquet as pq
from pyspark.sql import functions as F
from quirefold.llm import hilbert

from .data import SF, documents, empty


def test_curve_visits_each_cell_once_and_steps_by_one():
    for bits, dims in ((4, 2), (3, 3)):
        cells = [[c >> bits * i & (1 << bits) - 1 for i in range(dims)] for c in range(2 ** (bits * dims))]
        order = sorted(cells, key=lambda p: hilbert.curve_index(p, bits))
        assert sorted(hilbert.curve_index(p, bits) for p in cells) == list(range(len(cells)))
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(order, order[1:]))


def check(rows, docs, shards=24):
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = {}
    for r in rows:
        assert 0 <= r["shard"] < shards and r["law"] == "rows" and r["grown_shard"] is None
        slots.setdefault(r["shard"], []).append((r["slot"], r["curve"]))
    sizes = [len(slots.get(i, [])) for i in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    curve = []
    for i in range(shards):
        own = sorted(slots.get(i, []))
        assert [s for s, _ in own] == list(range(len(own)))
        curve += [c for _, c in own]
    assert curve == sorted(curve)


def test_tables_and_awkward_rows(spark):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), documents(spark), empty(spark)):
        check(hilbert.shard_documents(docs).collect(), docs.collect())


def test_a_hot_cell_and_fewer_rows_than_shards(spark):
    hot = spark.range(900).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    check(hilbert.shard_documents(hot).collect(), hot.collect())
    check(hilbert.shard_documents(hot.limit(5)).collect(), hot.limit(5).collect())


def test_shards_are_narrow_in_every_dimension(spark):
    r = spark.range(4096).select(F.col("id"), (F.col("id") % 64).alias("a"), F.floor(F.col("id") / 64).alias("b"))
    rows = hilbert.hilbert_shards(r, {"a": F.col("a"), "b": F.col("b")}, ["id", "a", "b"], ["id"], 16)
    spans = rows.groupBy("shard").agg((F.max("a") - F.min("a")).alias("a"), (F.max("b") - F.min("b")).alias("b")).collect()
    assert all(s["a"] <= 40 and s["b"] <= 40 for s in spans)


def test_files(spark, tmp_path):
    dealt = hilbert.shard_documents(spark.read.parquet(f"{SF}/documents.parquet"))
    hilbert.write_shards(dealt, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).groupBy("shard").count().count() == 24


def test_files_are_skipped_by_their_statistics(spark, tmp_path):
    """A filter on language and source opens few of the files that shards in Hilbert order make."""
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.pmod(F.xxhash64("id"), F.lit(90)).cast("int")).alias("text"),
        F.element_at(F.array(*map(F.lit, ("de", "en", "fr", "it"))), (F.pmod(F.hash("id"), F.lit(4)) + 1).cast("int")).alias("lang"),
        F.concat(F.lit("commoncrawl-"), F.lpad(F.pmod(F.hash("id", F.lit(1)), F.lit(16)).cast("string"), 2, "0")).alias("source"),
    )
    path = str(tmp_path / "shards")
    hilbert.write_shards(hilbert.shard_documents(docs, keep=("lang", "source")), path)
    files = glob.glob(f"{path}/*/*.parquet")
    opened = 0
    for file in files:
        meta = pq.ParquetFile(file).metadata
        own = {meta.schema.column(i).name: meta.row_group(0).column(i).statistics for i in range(meta.num_columns)}
        opened += own["lang"].min <= "fr" <= own["lang"].max and own["source"].min <= "commoncrawl-05" <= own["source"].max
    assert len(files) >= 48 and opened <= len(files) / 5
    assert spark.read.parquet(path).where("lang = 'fr' and source = 'commoncrawl-05'").count() == docs.where("lang = 'fr' and source = 'commoncrawl-05'").count()
