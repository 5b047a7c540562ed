import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from quirefold.llm import langid

from .data import SF, documents, empty


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/documents.parquet")
    out = langid.identify_documents(docs, ["doc_id", "lang"]).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    held = out[out.held_out]
    assert 250 < len(held) < 420 and (held.lang == held.lang_pred).mean() >= 0.97
    assert out.rejected.mean() < 0.01


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = langid.identify_documents(docs, ["doc_id"])
    assert rows.count() == docs.count()
    got = {r["doc_id"]: r for r in rows.collect()}
    for i in (0, 1, 2, 4):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"]
    assert got[5]["lang_pred"] in ("de", "fr")
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns
    assert langid.identify_documents(empty(spark), ["doc_id"]).count() == 0
    assert langid.accepted(empty(spark)).count() == 0


def test_far_texts_are_rejected_and_lang_is_no_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6 + 2, "Ωμέγα άλφα βήτα γάμμα δέλτα έψιλον ζήτα ήτα θήτα", "en")], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").union(odd)
    model = langid.fit(docs.select("text", "lang", F.col("doc_id").alias("key")))
    a = {r["doc_id"]: r for r in langid.identify(both, model, ["doc_id"]).collect()}
    b = {r["doc_id"]: r for r in langid.identify(both.withColumn("lang", F.lit("xx")), model, ["doc_id"]).collect()}
    assert a == b and a[10**6 + 2]["rejected"]


def near(text, texts, model):
    """Label and cosine of the nearest centroid, number by number."""
    def vector(x):
        counts = Counter(langid.grams(x).tolist())
        v = {b: (1 + math.log(n)) * float(model.idf[b]) for b, n in counts.items()}
        size = math.sqrt(sum(y * y for y in v.values()))
        return {b: y / size for b, y in v.items()}

    own = vector(text)
    return max((sum(y * float(c[b]) for b, y in own.items()), model.labels[model.owner[j]]) for j, c in enumerate(model.centres))


def test_assignment_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.select("text", "lang", F.col("doc_id").alias("key")), 30, 2)
    rows = [r for r in docs.select("doc_id", "text").collect() if len(langid.grams(r["text"]))][:80]
    seen = Counter(b for text, in docs.where("lang is not null").select("text").collect() for b in set(langid.grams(text).tolist()))
    assert len(seen) <= langid.BUCKETS and np.allclose(np.linalg.norm(model.centres, axis=1), 1, atol=1e-5)
    for row, (label, score, _) in zip(rows, model.predict([r["text"] for r in rows])):
        want = near(row["text"], None, model)
        assert abs(score - want[0]) < 1e-5 and label == want[1]


def test_columns_with_odd_names_stay(spark):
    docs = spark.createDataFrame([(1, "Ein Text.", "de", "x", 1), (2, "?!", "de", None, 2)] * 5, "doc_id long, text string, lang string, `extra col` string, `a.b` int")
    assert langid.accepted(docs).columns == docs.columns


def test_noise_and_unlearned_languages_are_rejected_and_clean_texts_stay(spark):
    docs = spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = langid.fit(docs.select("text", "lang", F.col("doc_id").alias("key")))
    texts = [r["text"] for r in docs.collect() if len(langid.grams(r["text"]))]
    assert np.mean([x[2] for x in model.predict(texts)]) < 0.005
    short = [" ".join(t.split()[:8]) for t in texts if len(t.split()) >= 8]
    assert np.mean([x[2] for x in model.predict(short)]) < 0.01
    r = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    noise = ["".join(r.choice(letters, 2000)) for _ in range(20)] + ["Ωμέγα άλφα βήτα γάμμα δέλτα έψιλον ζήτα ήτα θήτα"]
    assert all(x[2] for x in model.predict(noise))


def test_without_labels_texts_with_letters_stay(spark):
    docs = spark.createDataFrame([(1, "Some text", None), (2, "?!", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in langid.accepted(docs).collect()] == [1]


def test_many_values_of_lang_leave_the_model_bounded(spark):
    """5,000 values of lang: the 512 most frequent are learned, the first of equals."""
    docs = spark.range(5100).select(F.col("id").alias("doc_id"), F.concat(F.lit("value "), F.col("id") % 5000).alias("lang"), F.concat(F.lit("some text of its own "), "id").alias("text"))
    model = langid.fit(docs.select("text", "lang", F.col("doc_id").alias("key")), 3)
    assert len(model.labels) == 512 and {f"value {i}" for i in range(100)} <= set(model.labels) and "value 100" in model.labels
    assert langid.identify_documents(docs, ["doc_id"]).count() == 5100
