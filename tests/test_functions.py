"""Scalar functions against fixed examples."""

import math

import pytest
from pyspark.sql import functions as F
from quirefold.functions import amounts, geometry, hashing, numbers, text

ACCEPTED = {
    "cord_mixed_v1": {"75,000": "75000", "75.000": "75000", "1.500.000": "1500000", "1,500,000": "1500000", "75000": "75000", "0075": "75", "12.50": "12.50", "12,50": "12.50", "1,234.56": "1234.56", "1.234,56": "1234.56", "75.000,00": "75000", "Rp 75.000": "75000", "rp.75.000": "75000", "IDR75000": "75000", "₱ 12.50": "12.50", "PHP 1,000": "1000", "0": "0", "000": "0", "0.00": "0"},
    "dot_decimal_comma_grouping": {"75,000": "75000", "12.50": "12.50", "1,234.56": "1234.56"},
    "comma_decimal_dot_grouping": {"75.000": "75000", "12,50": "12.50", "1.234,56": "1234.56"},
}
REFUSED = {
    "cord_mixed_v1": {"": "no_candidate", "  ": "no_candidate", "Rp": "parse_failed", "10%": "unsupported", "-5": "unsupported", "(5)": "unsupported", "5-": "unsupported", "−5": "unsupported", "1 000": "ambiguous", "12.5": "ambiguous", "1,00,000": "ambiguous", "1.234.56": "ambiguous", "abc": "parse_failed", "12a": "parse_failed", "1,2345": "ambiguous", ".50": "ambiguous"},
    "dot_decimal_comma_grouping": {"75.000": "ambiguous", "12,50": "ambiguous", "1.234,56": "ambiguous"},
    "comma_decimal_dot_grouping": {"75,000": "ambiguous", "12.50": "ambiguous"},
}


def values(spark, rows, ddl, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*columns).collect()]


@pytest.mark.parametrize("policy", amounts.POLICIES)
def test_amounts(spark, policy):
    a = amounts.amount(F.col("s"), policy)
    rows = [(s,) for s in (*ACCEPTED[policy], *REFUSED[policy])]
    got = {s: (status, value) for s, status, value in values(spark, rows, "s string", "s", a["parse_status"], a["normalized_amount"])}
    assert got == {s: ("ok", v) for s, v in ACCEPTED[policy].items()} | {s: (v, None) for s, v in REFUSED[policy].items()}


def test_amount_currency_and_null(spark):
    a = amounts.amount(F.col("s"), currency="USD")
    got = values(spark, [("Rp 5",), ("php 5",), ("5",), (None,)], "s string", a["currency"], a["parse_status"])
    assert got == [("IDR", "ok"), ("PHP", "ok"), ("USD", "ok"), ("USD", "no_candidate")]


def test_answers(spark):
    rows = [("Total: 75.000!", "total 75 000"), (None, ""), ("a b_c", "a b_c"), ("Blüe²", "blüe²")]
    assert values(spark, rows, "a string, b string", text.normalize_answer(F.col("a")) == F.col("b")) == [(True,)] * 4
    pairs = [("abcd", "abxy", 0.5), ("abcd", "axyz", 0.0), ("", "", 1.0), ("same", "SAME", 1.0), ("night", "nacht", 0.6)]
    got = values(spark, pairs, "a string, b string, s double", text.anls(F.col("a"), F.col("b")), "s")
    assert all(math.isclose(a, b, abs_tol=1e-12) for a, b in got)
    golds = [("75.000", ["12", "75 000"], True), ("75", ["750"], False), ("x", [], False)]
    assert values(spark, golds, "p string, g array<string>, e boolean", text.exact_match(F.col("p"), F.col("g")) == F.col("e")) == [(True,)] * 3
    assert values(spark, [([],)], "g array<string>", text.best_anls(F.lit("x"), F.col("g"))) == [(None,)]


def test_words_and_prefixes(spark):
    rows = [(["a1", "b", "2c", "d"], "2c"), ([], ""), (["x"], "")]
    assert values(spark, rows, "w array<string>, a string", text.last_number(F.col("w")) == F.col("a")) == [(True,)] * 3
    pre = [("subtotal", "subtot", 6), ("", "x", 0), ("abc", "abd", 2), ("x", "y", 0)]
    assert values(spark, pre, "a string, b string, n int", text.common_prefix(F.col("a"), F.col("b")) == F.col("n")) == [(True,)] * 4
    on = [("Blue Yonder", "to Blue  Yonder, Inc", True), ("lue", "blue", False), ("", "x", False), ("w " * 21, "w " * 30, False), ("w " * 20, "w " * 30, True)]
    on += [("200 00", "rent $1,200.00/month due", False), ("1 200 00 month", "rent $1,200.00/month due", True), ("a b", "a - b", True), ("a b", f"a {'- ' * 18}b", True), ("a b", f"a {'- ' * 19}b", False)]
    on += [("a a b", "a a a b", True), ("a b", "a-b", True), ("a", "a-b", False), ("a b c", "x a-b c", True), (None, "x", False), ("x", "", False)]
    assert values(spark, on, "p string, t string, e boolean", text.answer_on_page(F.col("p"), text.words(F.col("t"))) == F.col("e")) == [(True,)] * len(on)


def test_answer_on_page_against_all_runs(spark):
    import random

    r = random.Random(6)
    bits = ["a", "B", "c.d", "a-b", "-", "b", "a b"]
    rows = [(" ".join(r.choices(bits, k=r.randint(1, 4))), r.choices([x for x in bits if " " not in x], k=r.randint(0, 30))) for _ in range(300)]
    clean = lambda x: " ".join("".join(c if c.isalnum() else " " for c in x.lower()).split())
    runs = lambda w: {" ".join(x for x in map(clean, w[i : i + k]) if x) for i in range(len(w)) for k in range(1, 21)}
    want = [(clean(p) != "" and clean(p) in runs(w),) for p, w in rows]
    assert values(spark, rows, "p string, w array<string>", text.answer_on_page(F.col("p"), F.col("w"))) == want
    assert 50 < sum(x for (x,) in want) < 250


def test_cells_and_keys(spark):
    rows = [("=1", "'=1"), ("  -x", "'  -x"), ("\tx", "'\tx"), ("a=1", "a=1"), (None, ""), ("+", "'+"), ("@a", "'@a")]
    assert values(spark, rows, "a string, b string", text.spreadsheet_safe(F.col("a")) == F.col("b")) == [(True,)] * 7
    keys = [("Ｔotal:", "total"), ("Straße", "strasse"), ("Sub-Total", "subtotal")]
    assert values(spark, keys, "a string, b string", text.key_text(F.col("a")) == F.col("b")) == [(True,)] * 3
    assert values(spark, [("a  ﬁ\n",)], "a string", text.clean(F.col("a"))) == [("a fi",)]


def test_numbers(spark):
    low, high = numbers.wilson(F.col("k"), F.col("n"))
    got = values(spark, [(0, 0), (0, 10), (10, 10), (8, 10)], "k long, n long", low, high)
    assert got[0] == (None, None) and got[1][0] == 0 and math.isclose(got[2][1], 1)
    assert math.isclose(got[3][0], 0.490162, abs_tol=1e-6) and math.isclose(got[3][1], 0.943318, abs_tol=1e-6)
    rows = [(1.0, 1.000009, True), (1.0, 1.1, False), (None, None, True), (None, 1.0, False)]
    assert values(spark, rows, "a double, b double, e boolean", numbers.close(F.col("a"), F.col("b")) == F.col("e")) == [(True,)] * 4
    test, validation = numbers.target_sizes(F.col("n"))
    assert values(spark, [(1,), (10,), (30,), (12,)], "n long", test, validation) == [(1, 0), (2, 2), (6, 4), (2, 2)]


def test_boxes(spark):
    box, region = F.col("b"), F.array(F.lit(5.0), F.lit(0.0), F.lit(20.0), F.lit(10.0))
    rows = [([0.0, 0.0, 10.0, 10.0],), ([3.0, 3.0, 3.0, 9.0],), ([-1.0, 0.0, 5.0, 5.0],), ([float("nan"), 0.0, 1.0, 1.0],)]
    assert [x[0] for x in values(spark, rows[:2], "b array<double>", geometry.overlap_share(box, region))] == [0.5, 0.0]
    assert [x[0] for x in values(spark, rows, "b array<double>", geometry.valid_box(box, F.lit(100), F.lit(100)))] == [True, False, False, False]
    assert values(spark, rows[:1], "b array<double>", geometry.to_grid(box, F.lit(30), F.lit(40))) == [([0, 0, 333, 250],)]
    quad = geometry.clip(F.array(*map(F.lit, (-5.0, 8.0))), F.array(*map(F.lit, (2.0, 50.0))), F.lit(100), F.lit(40))
    assert values(spark, rows[:1], "b array<double>", quad) == [([0.0, 2.0, 8.0, 40.0],)]


def test_turning_a_page_keeps_sizes_and_stays_inside(spark):
    for k in range(1, 9):
        turned = geometry.turn(F.col("b"), F.lit(k), F.lit(100), F.lit(60))
        (got, size), = values(spark, [([10.0, 5.0, 40.0, 20.0],)], "b array<double>", turned, geometry.turned_size(F.lit(k), F.lit(100), F.lit(60)))
        assert (got[2] - got[0], got[3] - got[1]) == ((30, 15) if k < 5 else (15, 30))
        assert 0 <= got[0] and got[2] <= size[0] and 0 <= got[1] and got[3] <= size[1]


def test_digests(spark):
    assert values(spark, [("hello\n",)], "s string", hashing.git_blob(F.col("s"))) == [("ce013625030ba8dba906f756967f9e9ca394464a",)]
    a = hashing.cache_key(x=F.col("s"), y=F.lit(1))
    b = hashing.cache_key(y=F.lit(1), x=F.col("s"))
    assert values(spark, [("q",)], "s string", a == b) == [(True,)]
