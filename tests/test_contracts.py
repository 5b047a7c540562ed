"""Rules as data: each kind by hand, empty tables, awkward values, one scan."""

from pyspark.sql import functions as F
from quirefold.operators import contracts
from quirefold.operators.contracts import Rule, broken_rules
from quirefold.plans.reports import QUERIES


def found(df):
    return {r.rule: (r.n, r.first_key) for r in df.collect()}


def test_each_kind_of_rule(spark):
    rows = [(3, "a", "x", True), (1, "a", "y", None), (2, "b", "x", False), (4, None, "z", True), (5, "c", None, None)]
    df = spark.createDataFrame(rows, "k long, g string, v string, ok boolean")
    rules = [
        Rule("row", "row", F.col("ok")), Rule("no row", "row", F.col("k") > 9), Rule("unique", "unique", F.col("g")), Rule("all unique", "unique", F.col("k")),
        Rule("crossing", "one_value", F.col("g"), F.col("v")), Rule("few", "rows", low=1, high=4), Rule("fits", "rows", low=5, high=5), Rule("kinds", "distinct", F.col("v"), low=4, high=9),
        Rule("three", "distinct", F.col("v"), low=3, high=3), Rule("needs", "needed", F.col("v"), needed=("x", "q", "r")), Rule("has", "needed", F.col("v"), needed=("x", "y")),
        Rule("some", "all_or_none", F.col("ok")), Rule("all", "all_or_none", F.col("k") > 0), Rule("none", "all_or_none", F.col("k") < 0),
    ]
    assert found(broken_rules(df, "k", rules)) == {"row": (2, "3"), "unique": (1, "1"), "crossing": (1, "1"), "few": (5, None), "kinds": (3, None), "needs": (2, None), "some": (3, "1")}
    assert found(broken_rules(df.where("false"), "k", rules)) == {"few": (0, None), "fits": (0, None), "kinds": (0, None), "three": (0, None), "needs": (3, None), "has": (2, None)}


def test_receipts(spark):
    good = (contracts.RECEIPT_SCHEMA, True, contracts.POLICIES[0], "PHP", "a:1", "x/1.png", "train", "g1")
    names = "schema string, authorized boolean, number_format_policy string, currency string, receipt_id string, image string, role string, group_id string, k int"
    judge = lambda rows, adapt=True: found(broken_rules(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], names), "k", contracts.receipt_rules(adapt)))
    others = [(*good[:4], f"b{i}", f"{i}.jpeg", role, f"h{i}") for i, role in enumerate(contracts.NEEDED_ROLES[1:])]
    assert judge([good, *others]) == {}
    assert judge([good]) == {"missing_roles": (3, None)}
    assert judge([(*good[:6], None, None)], adapt=False) == {} and judge([good], adapt=False) == {"role": (1, "0")}
    nulls = judge([(None,) * 8])
    assert {"schema", "not_authorized", "number_format_policy", "currency", "bad_receipt_id", "unsafe_image_path", "image_type", "role", "no_group", "missing_roles"} == set(nulls)
    assert judge([good, (*good[:4], "b", "x/1.png", "test", "g1"), *others[:2]])["group_in_two_roles"] == (1, "0")


def test_annotations_and_records(spark):
    schema = "receipt_id string, field string, status string, parsed struct<parse_status:string,normalized_amount:string>, canonical_value string, value_boxes array<array<double>>, width int, height int, provenance string"
    row = ("r", "f", "present", ("ok", "5"), "5", [[0.0, 0.0, 9.0, 9.0]], 10, 10, "me")
    judge = lambda **new: set(found(broken_rules(spark.createDataFrame([tuple(dict(zip([c.split()[0] for c in "receipt_id field status parsed canonical_value value_boxes width height provenance".split()], row), **new).values())], schema), "receipt_id", contracts.annotation_rules(("f",)))))
    assert judge() == set() and judge(status="not_annotated", provenance=None, value_boxes=None, parsed=None) == set()
    assert judge(canonical_value="6") == {"contradictory_value"} and judge(parsed=("bad", None)) == {"unsupported_amount"} and judge(parsed=None) == {"unsupported_amount"}
    for boxes in (None, [], [[0.0, 0.0, 9.0]], [[0.0, 0.0, 0.0, 9.0]], [[0.0, 0.0, 11.0, 9.0]], [[float("nan"), 0.0, 1.0, 1.0]], [None], [[0.0, None, 1.0, 1.0]]):
        assert judge(value_boxes=boxes) == {"value_boxes"}, boxes
    names = "id string, page_id long, file string, question string, words array<string>, boxes array<array<double>>, width int, height int, answers array<string>"
    record = lambda *r: set(found(broken_rules(spark.createDataFrame([r], names), "page_id", contracts.record_rules())))
    box = [[0.0, 0.0, 0.0, 9.0]]
    assert record("a", 1, "f", " q ", ["w"], box, 20, 20, None) == set() and record("a", 1, "f", "q", ["w"], box, 20, 20, ["x"]) == set()
    assert record("a", 1, "f", "q" * 257, [" ", "w"], box, 15, 20, [""]) == {"question", "blank_word", "box_count", "image_size", "answers"}
    assert record(None, 1, None, None, None, None, None, None, []) == {"missing_keys", "question", "image_size", "word_count", "answers", "page_count"}


def test_a_contract_reads_its_table_once(spark):
    for name in ("receipt_contract", "record_contract"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parquet") == 1
