import hashlib
import re

from pyspark.sql import functions as F
from quirefold.llm import decontaminate

from .data import SF, documents, empty, words

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall((text or "").encode().lower())


def brute(docs, items):
    """(n_words, n_hit, n_items, sha, contaminated) of each document."""
    windows = {}
    for item, text in items:
        w = split(text)
        n = min(13, len(w))
        for s in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(item))
    sizes, out = {len(k) for k in windows}, {}
    for i, text in docs:
        w, hit, found = split(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if own := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= own
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[i] = (len(w), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(w))
    return out


def result(df):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in df.collect()}


def test_tables_match_brute_force(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert result(decontaminate.contamination(docs, items)) == want
    assert any(x[4] for x in want.values())


def awkward_items():
    base = words(1, 300)
    return [(1, " ".join(base[45:75])), (2, "ONE"), (3, "two words!"), (4, None), (5, " .,"), (6, " ".join(base[60:64])), (1, "xx yy zz"), (7, " ".join(base[45:75])), (8, "naïve b İΣ")]


def test_awkward_rows(spark, monkeypatch):
    docs, rows = documents(spark), awkward_items()
    items = spark.createDataFrame(rows, "item_id long, text string")
    want = brute({(r["doc_id"], r["text"]) for r in docs.where("doc_id is not null").collect()}, rows)
    out = decontaminate.contamination(docs, items)
    assert out.count() == docs.count()
    assert result(out.where("doc_id is not null")) == want
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)  # the shuffled form
    assert result(decontaminate.contamination(docs, items).where("doc_id is not null")) == want
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.where("doc_id is not null").collect()} == {i for i, x in want.items() if not x[4]}


def test_empty_tables(spark):
    items = spark.createDataFrame(awkward_items(), "item_id long, text string")
    assert decontaminate.contamination(empty(spark), items).count() == 0
    out = decontaminate.contamination(documents(spark), items.where(F.lit(False)))
    assert {(r["n_hit"], r["contaminated"]) for r in out.collect()} == {(0, False)}


def test_share_limit(spark):
    item = [f"w{i}" for i in range(13)]
    rows = [(n, " ".join([*item, *(f"x{i}" for i in range(n - 13))])) for n in (13, 259, 260, 261)]
    out = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert {r["doc_id"]: r["contaminated"] for r in out.collect()} == {13: True, 259: True, 260: True, 261: False}
