"""Receipts are read once: plans of the queries on receipts, and receipts of more than a hundred items."""

import pytest
from pyspark.sql import functions as F
from quirefold.operators import rules
from quirefold.plans import queries, reports
from quirefold.sources import adapters

SF = "/root/testdata/sf0.001"
QUERIES = {**queries.QUERIES, **reports.QUERIES}


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


@pytest.fixture(scope="module")
def long_receipts(spark, tmp_path_factory):
    """Receipts of 3, 99, 100, 103 and 120 items; equal prices make amounts of items and feet meet."""
    at = tmp_path_factory.mktemp("long")
    sizes = spark.createDataFrame([(15, 3), (16, 99), (20, 100), (21, 103), (22, 120)], "o_orderkey long, n int")
    items = sizes.select(F.col("o_orderkey").alias("l_orderkey"), F.explode(F.sequence(F.lit(1), "n")).alias("l_linenumber"))
    price = F.when(F.col("l_linenumber") % 7 == 0, 0.0).otherwise(F.col("l_linenumber") * 10.0 + 1)
    items = items.select("*", (F.col("l_linenumber") % 9).cast("long").alias("l_partkey"), F.lit(1).cast("long").alias("l_suppkey"), F.lit(3.0).alias("l_quantity"), price.alias("l_extendedprice"))
    sizes.select("o_orderkey", F.lit(1).cast("long").alias("o_custkey"), F.lit("F").alias("o_orderstatus")).write.parquet(f"{at}/orders.parquet")
    items.write.parquet(f"{at}/lineitem.parquet")
    return str(at)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", ["span_alignment", "training_examples", "recoverability_rates"])
def test_alignment_reads_each_table_once(spark, name):
    assert scans(QUERIES[name](spark, SF)) == 2


def test_lines_of_one_number_are_one_line(spark, long_receipts):
    shown = adapters.lined_receipts(spark, long_receipts).select("receipt", adapters.shown_lines().alias("s"))
    got = shown.select("receipt", F.inline_outer("s")).select("receipt", "line", F.inline_outer("words"))
    want = adapters.receipt_tokens(spark, long_receipts).select("receipt", "line", "pos", "text")
    assert rows(got) == rows(want)
    order = [(r.receipt, [x.line for x in r.s], [[(w.pos, w.text) for w in x.words] for x in r.s]) for r in shown.collect()]
    assert all(lines == sorted(set(lines)) and all(w == sorted(w) for w in words) for _, lines, words in order)


def test_alignment_of_long_receipts(spark, long_receipts):
    t = adapters.receipt_tokens(spark, long_receipts)
    name = F.create_map(*[F.lit(x) for f, c in adapters.CATEGORY.items() for x in (c, f)])
    boxes = t.where(F.col("category").isin(*adapters.CATEGORY.values()) & ~F.col("is_key")).groupBy("receipt", F.element_at(name, F.col("category")).alias("field")).agg(F.collect_list("box").alias("boxes"))
    regions = adapters.references(spark, long_receipts).join(boxes, ["receipt", "field"])
    columns = ["receipt", "field", "status", "spans", "line", "start", "end"]
    assert rows(queries.span_alignment(spark, long_receipts).select(columns)) == rows(rules.align(t, regions).select(columns))


def test_rules_read_each_table_once_for_the_book_and_once_for_the_rows(spark):
    assert scans(queries.rule_extraction(spark, SF)) <= 4 and scans(queries.rule_scores(spark, SF)) <= 4


def test_rules_on_long_receipts(spark, long_receipts):
    t = adapters.receipt_tokens(spark, long_receipts)
    book = rules.derive_keywords(rules.phrase_counts(t, ascii_only=True), adapters.CATEGORY)
    want = rules.rule_extract(t, book, list(adapters.FIELDS), ascii_only=True)
    columns = ["receipt", "field", "parse_status", "raw_text", "normalized_amount", "span_score", "token_ids", "key_token_ids", "candidate_count", "candidate_token_ids"]
    assert rows(queries._extracted(spark, long_receipts).select(columns)) == rows(want.select(columns))


@pytest.mark.parametrize("name,most", [("system_reports", 2), ("evaluation_rows", 2), ("paraphrases", 2), ("encoded_examples", 2)])
def test_reports_read_each_table_once(spark, name, most):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == most and "from_json" not in plan
