import numpy as np
import pytest
from pyspark.sql import functions as F
from quirefold.llm import minhash
from quirefold.llm.components import connected_components

from .data import SF, documents, empty


def brute(rows):
    """component of each doc_id by comparing all pairs of word-shingle sets."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    ids = sorted(sets)
    where = {}
    for i in ids:
        for s in sets[i]:
            where.setdefault(s, []).append(i)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in ids:
        counts = {}
        for s in sets[i]:
            for j in where[s]:
                if j > i:
                    counts[j] = counts.get(j, 0) + 1
        for j, n in counts.items():
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


def result(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_tables_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert result(minhash.near_duplicates(docs)) == brute([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_awkward_rows(spark):
    docs = documents(spark)
    out = minhash.near_duplicates(docs)
    assert out.count() == docs.count()
    stray = out.where("doc_id is null").first()
    assert stray["component_id"] is None and stray["kept"]
    got = result(out.where("doc_id is not null"))
    assert got == brute([(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()])
    assert got[7][1] == 6 and got[8][1] == 6 and got[9][1] == 9
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_group_of_many_near_copies_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "BUCKET_BLOCK", 4)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[: 5 * (i % 7)] + [f"x{i}"] * (i % 3) + base[5 * (i % 7) + 1 :])) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(minhash.near_duplicates(docs)) == brute(rows)


def test_estimate_is_close():
    r = np.random.default_rng(1)
    shared, a, b = (r.integers(0, 2**63, 2000, dtype=np.uint64) for _ in range(3))
    one, two = (minhash.signature(np.unique(np.concatenate((shared, x[:500]))))[1] for x in (a, b))
    assert abs(minhash.estimates(one[None], two[None])[0, 0] - 2000 / 3000) < 0.2


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 140)}


def test_a_long_chain_of_different_sets_stays_linear(spark, monkeypatch):
    """Each text is the one before moved on by a word: one group, of which only near neighbours are linked."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    stream = [f"w{i}" for i in range(1500)]
    rows = [(i, " ".join(stream[i : i + 64])) for i in range(0, 1400)]
    rows += [(2000 + i, " ".join(["t"] + stream[:50] + [f"y{i}.{j}" for j in range(12)])) for i in range(60)]  # alike, but not enough
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(minhash.near_duplicates(docs)) == brute(rows)
    sets = minhash.set_table(docs, docs.select("doc_id", F.lit(0).cast("long").alias("label"), F.lit(1).cast("long").alias("blocks")))
    assert minhash.rare_shingles(sets, 85).count() <= len(rows) * 10


def test_links_at_eighty_per_cent_and_refused_ids(spark):
    base = [f"w{i}" for i in range(104)]
    rows = [(1, " ".join(base)), (2, " ".join([*base[:93], *(f"x{i}" for i in range(11))]))]  # 89 of 111 shingles
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(minhash.near_duplicates(docs))[2] == (100, 2)
    assert result(minhash.near_duplicates(docs, 80))[2] == (100, 1)
    with pytest.raises(TypeError):
        minhash.near_duplicates(docs.select(F.col("doc_id").cast("string"), "text"))
