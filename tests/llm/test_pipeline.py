import corpus_pipeline
from pyspark.sql import functions as F
from quirefold.llm import langid
from quirefold.llm.common import cut
from quirefold.llm.packing import CAPACITY

from . import test_decontaminate, test_minhash, test_packing, test_substrings
from .data import SF, documents


def test_stages_against_brute_force(spark, tmp_path):
    """Every stage on its predecessor's output, each compared with the brute-force version of its operator."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        texts = [(i, r["text"]) for i, r in before.items()]
        if name != "best_fit_packing":
            assert docs.columns == names
        after = {} if name == "best_fit_packing" else {r["doc_id"]: r["text"] for r in rows}
        if name == "language_id":
            assert set(after) == {i for i, t in texts if len(langid.grams(t))}
        elif name == "near_dedup":
            assert set(after) == {i for i, (_, c) in test_minhash.brute(texts).items() if i == c}
        elif name == "substring_dedup":
            assert set(after) == set(before)
            want = test_substrings.brute(texts)
            got = test_substrings.brute([(i, t) for i, t in after.items()])
            assert {i: x[0] - x[1] for i, x in want.items()} == {i: x[0] for i, x in got.items()}
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(after) == {i for i, x in test_decontaminate.brute(texts, items).items() if not x[4]}
        else:
            test_packing.check(rows, dict(texts), CAPACITY)


def test_run_on_awkward_rows(spark, tmp_path):
    docs = documents(spark).withColumn("extra col", F.lit(1)).withColumn("row", F.lit("x")).withColumn("text_hash", F.lit(2))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "one two"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = cut(stage(spark, left, str(tmp_path)), name)
        assert left.columns == docs.columns
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    pieces = [r["doc_id"] for r in rows if r["piece"] == 0]
    assert sorted(pieces, key=str) == sorted((r["doc_id"] for r in left.collect()), key=str)
    ids = set(pieces)
    assert {6, 9, 10} <= ids and not {0, 1, 2, 4, 7, 8} & ids  # texts with letters stay; copies, near copies and texts without letters go
