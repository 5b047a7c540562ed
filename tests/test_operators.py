"""Operators on small cases: ties, nulls, empty tables, files and streams."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from quirefold.operators import compare, metrics, ordering, pages, policy, readers, rules, validate
from quirefold.plans.queries import QUERIES
from quirefold.sources import files
from quirefold.streaming import intake, stream_pages

TOKENS = "receipt long, line int, pos int, text string, box array<double>, confidence double, category string, is_key boolean"
RULES = "field string, phrase string, support long, purity double"


def tokens(spark, *lines):
    """Lines of words 100 wide, 20 apart."""
    rows = [(1, n, p, w, [100.0 * p, 20.0 * n, 100.0 * p + 90, 20.0 * n + 16], 90.0, None, False) for n, line in enumerate(lines) for p, w in enumerate(line.split())]
    return spark.createDataFrame(rows, TOKENS)


def extracted(spark, *lines):
    book = spark.createDataFrame([("subtotal_amount", "sub total", 9, 1.0), ("total_amount", "total", 50, 0.9), ("tax_amount", "tax", 9, 1.0)], RULES)
    out = rules.rule_extract(tokens(spark, *lines), book, ["subtotal_amount", "tax_amount", "total_amount"])
    return {r["field"]: (r["parse_status"], r["raw_text"], r["normalized_amount"]) for r in out.collect()}


def test_longer_phrases_are_taken_first(spark):
    got = extracted(spark, "Sub Total 10.000", "TOTAL: Rp 11.000")
    assert got["subtotal_amount"] == ("ok", "10.000", "10000") and got["total_amount"] == ("ok", "Rp 11.000", "11000")
    assert got["tax_amount"] == ("no_candidate", None, None)


def test_next_line_rightmost_and_ties(spark):
    assert extracted(spark, "Total", "5 7.000 9.000")["total_amount"] == ("ok", "9.000", "9000")
    assert extracted(spark, "Total 8.000", "x", "Total 9.000")["total_amount"][0] == "ambiguous"
    assert extracted(spark, "Total 8.000", "x", "Total 8,000")["total_amount"][2] == "8000"
    assert extracted(spark, "Total 10%", "x y", "4.000")["total_amount"][0] == "no_candidate"


def test_keyword_lookup_ties_go_to_the_last_word(spark):
    rows = [(1, "What is the subtotal?", ["Subt", "1", "subtotal", "x", "22", "9"]), (2, "tax", ["Tax", "none"]), (3, "zzz", ["a", "5"]), (4, "tax amount", ["tax", "tax", "3"]), (5, None, ["7"])]
    df = spark.createDataFrame(rows, "id long, q string, w array<string>")
    assert {r["id"]: r["answer"] for r in df.select("id", metrics.keyword_lookup(F.col("q"), F.col("w")).alias("answer")).collect()} == {1: "22", 2: "", 3: "5", 4: "3", 5: "7"}


def totals(spark, good, bad, wrong_score):
    """Right answers with scores 0.9 - 0.001 i, then wrong ones, as in a policy set."""
    rows = [("a", i, "ok", 0.9 - 0.001 * i, True) for i in range(good)] + [("a", good + i, "ok", wrong_score, False) for i in range(bad)]
    return spark.createDataFrame(rows, "system_id string, receipt long, parse_status string, span_score double, correct boolean")


def test_policies(spark):
    best = policy.select(policy.sweep(totals(spark, 40, 10, 0.1))).first()
    assert best["policy_feasible"] and best["accepted"] == 40 and best["errors"] == 0 and math.isclose(best["coverage"], 0.8)
    none = policy.select(policy.sweep(totals(spark, 10, 40, 0.95))).first()
    assert not none["policy_feasible"] and none["kind"] == "refer_all" and none["threshold"] is None
    point = policy.coverage_point(policy.sweep(totals(spark, 40, 10, 0.1)), 0.3).first()
    assert point["accepted"] == 15 and point["reached_requested"]
    hard = spark.createDataFrame([("a", 1, "ambiguous", 0.9, False), ("a", 2, "ok", None, True), ("a", 3, "ok", float("nan"), None)], "system_id string, receipt long, parse_status string, span_score double, correct boolean")
    rows = policy.sweep(hard).collect()
    assert [(r["kind"], r["scoreable"], r["accepted"]) for r in rows] == [("refer_all", 2, 0)]
    empty = policy.coverage_point(policy.sweep(hard), 0.5).first()
    assert empty["selected_state"] == "refer_all" and not empty["reached_requested"]
    with pytest.raises(ValueError):
        policy.coverage_point(policy.sweep(hard), 0.01)


def test_rank_and_running_total_match_one_sort(spark):
    df = spark.range(500).select(F.col("id"), (F.col("id") % 7).alias("n"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    order = [r["id"] for r in df.orderBy("h").collect()]
    assert {r["id"]: r["rank"] for r in ordering.hash_rank(df, "h").collect()} == {k: i for i, k in enumerate(order)}
    sums = np.cumsum([0, *(k % 7 for k in order)])
    assert {r["id"]: r["before"] for r in ordering.hash_running_total(df, "h", "n").collect()} == {k: s for k, s in zip(order, sums.tolist())}


def test_splits_and_families(spark):
    groups = spark.createDataFrame([(i, 1 + i % 3) for i in range(30)], "page long, n long")
    split = {r["page"]: r for r in pages.greedy_split(groups, "page", "n", 12, 9, "t").collect()}
    size = {s: sum(r["n"] for r in split.values() if r["split"] == s) for s in ("test", "validation", "train")}
    assert 12 <= size["test"] < 15 and 9 <= size["validation"] < 12 and sum(size.values()) == 60
    docs = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "b", "y"), (5, "c", "x")], "id long, text string, role string")
    assert {r["id"]: r["verdict"] for r in pages.duplicate_families(docs, "id", F.col("text"), F.col("role")).collect()} == {1: "kept", 2: "excluded", 3: "quarantined", 4: "quarantined"}
    got = {r["key"]: r["position"] for r in pages.seeded_order(spark, list(range(5)), 42).collect()}
    import random

    want = list(range(5))
    random.Random(42).shuffle(want)
    assert got == {k: i for i, k in enumerate(want)}
    with pytest.raises(ValueError):
        pages.seeded_order(spark, list(range(20_001)), 1)


def test_best_span_matches_numpy(spark):
    r = np.random.default_rng(5)
    for n in (1, 3, 40):
        s, e = r.normal(size=n) * 3, r.normal(size=n) * 3
        p, q = np.exp(s) / np.exp(s).sum(), np.exp(e) / np.exp(e).sum()
        table = np.triu(np.outer(p, q)) - np.triu(np.outer(p, q), 15)
        i, j = divmod(int(table.argmax()), n)
        df = spark.createDataFrame([(1, s.tolist(), e.tolist())], "id long, s array<double>, e array<double>")
        got = readers.decode_span(df, "id", F.col("s"), F.col("e")).first()
        assert (got["answer_start"], got["answer_end"]) == (i, j) and math.isclose(got["score"], table.max())


def test_readers_are_pluggable_and_checked(spark):
    df = spark.createDataFrame([(1, "q", ["a", "b"]), (2, "q", [])], "page_id long, question string, words array<string>")
    rows = {r["page_id"]: r["answer"] for r in readers.read_answers(df, "page_id", readers.hashed_reader).collect()}
    assert rows[1] in ("a", "b") and rows[2] == ""
    outside = lambda f: pd.DataFrame({"start": [0] * len(f), "end": [9] * len(f), "score": 0.0, "n_windows": 1})
    with pytest.raises(Exception, match="outside its page"):
        readers.read_answers(df, "page_id", outside).collect()


def test_windows_cover_a_page(spark):
    df = spark.createDataFrame([(1, 0), (2, 496), (3, 497), (4, 2000)], "id long, n int")
    got = {}
    for r in readers.windows(df, "id", F.lit(12), F.col("n")).orderBy("id", "window").collect():
        got.setdefault(r["id"], []).append((r["start"], r["stop"]))
    assert got[1] == [(0, 0)] and got[2] == [(0, 496)] and got[3] == [(0, 496), (368, 497)]
    assert got[4][-1][1] == 2000 and all(b[0] == a[0] + 368 for a, b in zip(got[4], got[4][1:]))


def test_document_violations(spark):
    rows = [
        (["a"], [[0.0, 0.0, 1.0, 1.0]], None), (["a"], [[1.0, 1.0, 1.0, 1.0]], None), ([], [], "no_words"), (["a", " "], [[0.0] * 4] * 2, "blank_word"), (["a"], [], "box_count"),
        (["a"], [[0.0, 0.0, 11.0, 1.0]], "bad_box"), (["a"], [[float("nan"), 0.0, 1.0, 1.0]], "bad_box"), (["a"], [[0.0, 0.0, 1.0]], "bad_box"), (["a"], [[0.0, None, 1.0, 1.0]], "bad_box"), (None, None, "no_words"),
    ]
    df = spark.createDataFrame(rows, "w array<string>, b array<array<double>>, why string")
    got = df.select("why", validate.document_violation(F.col("w"), F.col("b"), F.lit(10), F.lit(10)).alias("v")).collect()
    assert [r["v"] for r in got] == [r["why"] for r in got]


def test_json_lines_and_exports(spark, tmp_path):
    good = {"id": "a", "page_id": "p", "question": "q", "words": ["x"], "boxes": [[0, 0, 1, 1]], "image_size": [5, 5], "answer_start": 0, "answer_end": 0, "answers": ["x"]}
    (tmp_path / "in.jsonl").write_text("\n".join([json.dumps(good), "", "[1]", "{broken", '{"id": 3, "words": "no list"}']))
    records, refused = files.read_jsonl(spark, str(tmp_path / "in.jsonl"))
    assert [r["id"] for r in records.collect()] == ["a"] and refused.count() == 3
    files.write_records(records.drop("file"), str(tmp_path / "out"))
    again, none = files.read_jsonl(spark, str(tmp_path / "out"))
    assert again.count() == 1 and none.count() == 0
    line = next((tmp_path / "out").glob("part-*.json")).read_text().splitlines()[0]
    assert list(json.loads(line)) == list(good)
    files.write_csv(spark.createDataFrame([("=1+1", [1, 2])], "a string, b array<int>"), str(tmp_path / "csv"))
    assert spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv")).collect() == [("'=1+1", "[1,2]")]
    (tmp_path / "twice.json").write_text('{"a": 1, "a": 2}')
    with pytest.raises(ValueError):
        files.strict_json(str(tmp_path / "twice.json"))


def test_manifest_and_digests(spark):
    have = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"y")), ("c", bytearray(b"z"))], "path string, content binary")
    sha = "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    listed = spark.createDataFrame([("a", 1, sha), ("b", 1, sha), ("d", 1, sha)], "path string, bytes long, sha256 string")
    assert {r["path"]: r["problem"] for r in files.verify_digests(have, listed).collect()} == {"b": "digest", "c": "undeclared", "d": "missing"}
    text = spark.createDataFrame([(1, f"see {sha} and {sha[:40]} x{sha}"), (2, None)], "id long, text string")
    assert [r["digest"] for r in files.quoted_digests(text, "id", "text", 64).collect()] == [sha]


def test_bootstrap_is_centred(spark):
    scored = spark.range(2000).select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("system_id"), F.col("id").alias("receipt"))
    scored = scored.withColumn("field", F.lit("f")).withColumn("correct", F.when(F.col("system_id") == "a", F.col("receipt") % 10 < 8).otherwise(F.col("receipt") % 10 < 6))
    got = metrics.paired_bootstrap(scored, "a", "b", "f").first()
    assert got["n"] == 2000 and math.isclose(got["difference"], 0.2) and 0.17 < got["low"] < 0.2 < got["high"] < 0.23


def test_replay_and_upsert(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k long, v double")
    b = spark.createDataFrame([(1, 1.000001), (2, 2.1), (4, 1.0)], "k long, v double")
    assert {r["k"] for r in compare.replay_differences(a, b, ["k"], ["v"]).collect()} == {2, 3, 4}
    assert sorted(compare.upsert(a, b, "k").select("k", "v").collect(), key=str) == sorted([(1, 1.000001), (2, 2.1), (3, None), (4, 1.0)], key=str)


def test_stream_intake(spark, tmp_path):
    (tmp_path / "in").mkdir()
    rows = [("1", "Total: 5", "2026-01-01T00:00:00"), ("2", "total 5!", "2026-01-01T00:01:00"), ("3", "other", "2026-01-01T00:02:00")]
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(dict(zip(("page_id", "text", "at"), r))) for r in rows))
    query = intake(stream_pages(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("pages_in").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("pages_in").collect()
    assert len(got) == 2 and {tuple(r["words"]) for r in got} >= {("other",)}


def test_group_rank_keeps_nulls_and_splits_skewed_keys(spark):
    rows = [(g, k) for g in ("a", None) for k in [*range(150), *[7] * 150, 10**15, None, None]]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, g string, k long").repartition(3)
    got = ordering.group_rank(df, "g", "k", rows=40).collect()
    assert len(got) == len(rows)
    for g in ("a", None):
        own = sorted((r["rank"], r["k"]) for r in got if r["g"] == g)
        assert [r for r, _ in own] == list(range(303))
        assert [k for _, k in own] == [*sorted(k for h, k in rows if h == g and k is not None), None, None]
    parts = ordering.steps(df, "k", 40).groupBy("_step", "_tie").count().collect()
    assert max(r["count"] for r in parts) <= 120
    assert ordering.group_rank(df.limit(0), "g", "k").count() == 0


def test_questions_for_any_item_and_page_ids(spark, tmp_path):
    docs = [(None, "s", "en", "total 12 apples"), (0, None, None, "total 12 apples"), (1, "s", "en", "page 3 of 4"), (-1, None, "en", "7"), (5, "t", None, None)]
    spark.createDataFrame(docs, "doc_id long, source string, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(17, "total apples"), (40, "which page")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = str(tmp_path)
    ids = {r["doc_id"]: r["id"] for r in QUERIES["corpus_ids"](spark, at).collect()}
    assert ids == {None: "s-001", 0: None, 1: "s-000", -1: None, 5: "t-000"}
    answers = {r["page_id"]: r["answer"] for r in QUERIES["keyword_lookup"](spark, at).collect()}
    assert answers[0] == "12" and answers[1] == "3" and set(answers) == {None, 0, 1, -1, 5}
    assert QUERIES["reader_answers"](spark, at).count() == 5
    assert sum(r["n"] for r in QUERIES["keyword_baseline"](spark, at).collect()) == 5


BOOK = [("subtotal_amount", "sub total", 9, 1.0), ("total_amount", "total", 50, 0.9), ("total_amount", "total amount due incl", 3, 1.0), ("tax_amount", "tax", 9, 1.0)]


def rows_of(spark, words, **more):
    """words: (line, pos, text, confidence) of receipt 1."""
    rows = [(1, n, p, w, [100.0 * p, 20.0 * n, 100.0 * p + 90, 20.0 * n + 16], c, None, False) for n, p, w, c in words]
    out = rules.rule_extract(spark.createDataFrame(rows, TOKENS), spark.createDataFrame(BOOK, RULES), ["total_amount", "tax_amount"], **more)
    return {r["field"]: r for r in out.collect()}


def test_a_missing_confidence_leaves_no_score(spark):
    for c, want in ((90.0, 0.8), (None, None), (120.0, None), (-1.0, None), (float("nan"), None), (0.0, 0.0)):
        got = rows_of(spark, [(0, 0, "TOTAL", 80.0), (0, 1, "9.000", c)])["total_amount"]
        assert got["normalized_amount"] == "9000" and got["span_score"] == want


def test_full_width_words_and_digits(spark):
    got = rows_of(spark, [(0, 0, "ＴＯＴＡＬ", 80.0), (0, 1, "９.０００", 90.0)])["total_amount"]
    assert (got["parse_status"], got["raw_text"], got["normalized_amount"]) == ("ok", "9.000", "9000")


def test_long_phrases_reasons_and_word_ids(spark):
    words = [(0, i, w, 90.0) for i, w in enumerate(("Total", "Amount", "Due", "incl.", "Rp", "5.000"))] + [(1, 0, "Tax", 90.0), (2, 0, "x", 90.0), (3, 0, "Total", 90.0), (3, 1, "7.000", 90.0)]
    got = rows_of(spark, words)
    total, tax = got["total_amount"], got["tax_amount"]
    assert (total["raw_text"], total["token_ids"], total["key_token_ids"], total["candidate_count"]) == ("Rp 5.000", [4, 5], [0, 1, 2, 3], 2)
    assert (tax["parse_status"], tax["reasons"], tax["candidate_count"]) == ("no_candidate", ["no_keyword_amount"], 0)
    tied = rows_of(spark, [(0, 0, "Total", 90.0), (0, 1, "1.000", 90.0), (1, 0, "Total", 90.0), (1, 1, "2.000", 90.0)])["total_amount"]
    assert (tied["parse_status"], tied["reasons"], tied["candidate_token_ids"]) == ("ambiguous", ["tied_distinct_candidates"], [[1], [3]])


def test_refused_documents_fail(spark):
    failures = spark.createDataFrame([(1, "ocr_timeout"), (2, "ocr_empty")], "receipt long, failure string")
    rows = spark.createDataFrame([(1, 0, 0, "Total", [0.0, 0.0, 9.0, 9.0], 9.0, None, False)], TOKENS)
    out = rules.rule_extract(rows, spark.createDataFrame(BOOK, RULES), ["total_amount"], failures=failures).collect()
    assert sorted((r["receipt"], r["parse_status"], r["reasons"]) for r in out) == [(1, "failed", ["ocr_timeout"]), (2, "failed", ["ocr_empty"])]
    assert rules.rule_extract(rows.limit(0), spark.createDataFrame(BOOK, RULES), ["total_amount"]).count() == 0


def test_training_examples_say_why_there_is_none(spark):
    rows = [(1, "a", "present_usable", "aligned", 1, 2, 2, 30), (1, "b", "present_usable", "aligned", 2, 2, 2, 30), (1, "c", "not_annotated", "no_usable_reference", None, None, None, 30), (2, "a", "present_usable", "ambiguous_alignment", None, None, None, 30), (2, "b", "present_usable", "aligned", 1, 1, 1, 900)]
    df = spark.createDataFrame(rows, "receipt long, field string, state string, status string, line int, start int, end int, n_tokens int")
    got = {(r["receipt"], r["field"]): (r["outcome"], r["start"]) for r in rules.training_examples(df, ["b", "a", "c"], most=1).collect()}
    assert got == {(1, "b"): ("aligned", 2), (1, "a"): ("per_receipt_ceiling", None), (1, "c"): ("not_annotated", None), (2, "a"): ("ambiguous_alignment", None), (2, "b"): ("training_window_limit", None)}


def test_token_spans_and_fits(spark):
    df = spark.createDataFrame([(1, [None, None, 0, 0, 1, 2, None], 0, 1), (2, [None, 0], 1, 1), (3, None, 0, 0)], "id long, w array<int>, a int, b int")
    assert [tuple(r) for r in df.select("id", readers.token_span(F.col("w"), F.col("a"), F.col("b")).alias("s")).select("id", "s.*").orderBy("id").collect()] == [(1, 2, 4), (2, None, None), (3, None, None)]
    fits, dropped = readers.check_fit(spark.createDataFrame([(1, 496), (2, 497), (3, None)], "id long, n int"), F.lit(12), F.col("n"))
    assert [r["id"] for r in fits.collect()] == [1] and sorted(r["id"] for r in dropped.collect()) == [2, 3]


def test_splits_below_their_minimum(spark):
    df = spark.createDataFrame([("train",)] * 8 + [("test",)], "split string")
    assert {r["split"]: (r["n"], r["missing"]) for r in pages.split_shortfalls(df, "split").collect()} == {"validation": (0, 2), "test": (1, 1)}


def test_json_arrays_and_other_suffixes(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "x", "answer_start": 1}, 5, {"id": "y"}]')
    (tmp_path / "b.json").write_text('{"id": "x"}')
    good, bad = files.read_dataset(spark, str(tmp_path / "a.json"))
    assert sorted(r["id"] for r in good.collect()) == ["x", "y"] and bad.count() == 1
    with pytest.raises(ValueError):
        files.read_dataset(spark, str(tmp_path / "a.csv"))
    header = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    df = spark.createDataFrame([(header,), (header[:-1],), (None,)], "h string")
    assert [r[0] for r in df.select(files.tsv_header(F.col("h"))).collect()] == [True, False, False]


@pytest.mark.parametrize("n,p,q", [(50, 0.8, 0.7), (5000, 0.8, 0.7), (3000, 0.5, 0.499), (40, 1.0, 0.9), (30, 0.6, 0.6)])
def test_bootstrap_is_that_of_resampled_receipts(spark, n, p, q):
    """Each resample has n receipts; differences spread, and the interval lies, as those of resampled lists."""
    r = np.random.default_rng(1)
    a, b = r.random(n) < p, r.random(n) < q
    counts = spark.createDataFrame([(n, int((a & ~b).sum()), int((b & ~a).sum()))], "n long, better long, worse long")
    rows = metrics.resampled_counts(counts).toPandas()
    assert len(rows) == 2000 and (rows.n == n).all() and ((rows.better >= 0) & (rows.worse >= 0) & (rows.better + rows.worse <= n)).all()
    draws = r.integers(0, n, (20_000, n)) if n <= 50 else r.integers(0, n, (4000, n))
    want = a[draws].mean(1) - b[draws].mean(1)
    got = ((rows.better - rows.worse) / n).to_numpy()
    spread = want.std() or 1 / n
    assert abs(got.mean() - want.mean()) < 0.1 * spread and abs(got.std() / spread - 1) < 0.08
    scored = spark.createDataFrame([(s, i, "f", bool(x[i])) for s, x in (("a", a), ("b", b)) for i in range(n)], "system_id string, receipt long, field string, correct boolean")
    out = metrics.paired_bootstrap(scored, "a", "b", "f").first()
    low, high = np.quantile(want, [0.025, 0.975])
    assert out["n"] == n and math.isclose(out["difference"], a.mean() - b.mean(), abs_tol=1e-12)
    assert abs(out["low"] - low) < 0.25 * spread + 1 / n and abs(out["high"] - high) < 0.25 * spread + 1 / n


def test_binomial_draws_are_the_inverse_distribution(spark):
    cases = [(n, p, u) for n in (0, 1, 7, 60, 100_000) for p in (0.0, 0.0002, 0.1, 0.5, 0.93, 1.0) for u in (1e-9, 0.03, 0.31, 0.5, 0.77, 0.999, 1 - 1e-9) if n * p * (1 - p) < 25]
    df = spark.createDataFrame(cases, "n long, p double, u double")
    got = [x[0] for x in df.select(metrics.binomial(F.col("n"), F.col("p"), F.col("u"), F.lit(0.3))).collect()]

    def inverse(n, p, u):
        flip, q = p > 0.5, min(p, 1 - p)
        chance = upto = math.exp(n * math.log1p(-q))
        k = 0
        while upto < u and k < min(n, 150):
            k += 1
            chance *= (n - k + 1) / k * q / (1 - q)
            upto += chance
        return n - k if flip else k

    assert got == [inverse(*c) for c in cases]
    wide = spark.range(4000).select(metrics.binomial(F.lit(10_000_000_000), F.lit(0.3), metrics.uniform(F.col("id"), F.lit("u")), metrics.uniform(F.col("id"), F.lit("v"))).alias("k")).toPandas().k
    sd = math.sqrt(1e10 * 0.21)
    assert abs(wide.mean() - 3e9) < 4 * sd / math.sqrt(4000) and abs(wide.std() / sd - 1) < 0.05


def test_bootstrap_without_receipts(spark):
    scored = spark.createDataFrame([], "system_id string, receipt long, field string, correct boolean")
    assert tuple(metrics.paired_bootstrap(scored, "a", "b", "f").first()) == (0, None, None, None)


def test_a_plan_that_binds_its_words_once(spark):
    plan = QUERIES["page_violations"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    plan = QUERIES["system_metrics"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 4


def test_reasons_are_counted_by_system_and_field(spark):
    rows = [("a", "f", ["x", "y"]), ("a", "f", ["x"]), ("a", "f", []), ("a", "g", None), ("b", "f", ["y", "y"])]
    got = metrics.failure_reasons(spark.createDataFrame(rows, "system_id string, field string, reasons array<string>"))
    assert sorted(tuple(r) for r in got.collect()) == [("a", "f", "x=2; y=1"), ("a", "g", ""), ("b", "f", "y=2")]


def test_ocr_report(spark):
    rows = [("t", "ok", 5, True), ("t", "ok", 2001, False), ("t", "ocr_error", 0, False), ("u", "ocr_empty", 0, True), (None, "image_error", 0, False)]
    got = {r["role"]: tuple(r)[1:] for r in metrics.ocr_report(spark.createDataFrame(rows, "role string, status string, n_tokens int, cached boolean"), "role").collect()}
    assert got == {"t": (3, 2, 0, 0, 1, 0, 1, 1, 5, 2001), "u": (1, 0, 1, 0, 0, 0, 0, 1, 0, 0), None: (1, 0, 0, 0, 0, 1, 0, 0, 0, 0)}
