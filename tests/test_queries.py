"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
from quirefold.plans import oracles, queries, report_oracles, reports

QUERIES, ORACLES = {**queries.QUERIES, **reports.QUERIES}, {**oracles.ORACLES, **report_oracles.ORACLES}

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "~"
    return str(value) if isinstance(value, (bool, str)) else repr(round(float(value), 9) + 0.0)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


def test_queries_without_sql_give_rows(spark):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, SF).count() > 0, name


def test_no_python_in_plans_but_where_it_is_needed(spark):
    python = {"key_text", "reader_answers", "window_encoding", "encoded_spans", "encoded_examples"}
    for name, query in QUERIES.items():
        plan = query(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert ("Python" in plan or "Arrow" in plan or "InPandas" in plan) == (name in python), name
