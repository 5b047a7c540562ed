"""Contracts of tables as data: rules on rows, groups and whole tables, judged side by side in one scan (VAL-08, VAL-09, VAL-10)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, collapse
from .validate import unsafe_path

# The schema, policies, roles and limits of users' receipts and pages.
RECEIPT_SCHEMA = "org.dimer.receipt-byod.v1"
POLICIES = ("dot_decimal_comma_grouping", "comma_decimal_dot_grouping")
ROLES, NEEDED_ROLES = ("train", "validation_model", "validation_policy", "test", "inference"), ("train", "validation_model", "validation_policy", "test")
MOST_RECEIPTS, MOST_RECORDS, MOST_PAGES, MOST_WORDS, MOST_QUESTION, SIDES = 1000, 500, 100, 2000, 256, (16, 4096)
RECEIPT_ID = r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,95}$"


class Rule(NamedTuple):
    """One rule. kind says what breaks it:

    row: a row where ``test`` is true; unique: a value of ``test`` that more than one row has; one_value: a group
    (``test``) whose rows have more than one ``value``; rows, distinct: a number of rows, or of values of ``test``,
    outside ``low`` to ``high``; needed: a value of ``needed`` that no row has in ``test``; all_or_none: rows where
    ``test`` is true beside others where it is not. Nulls in a test are false, null values and groups have no say.
    """

    name: str
    kind: str
    test: Column | None = None
    value: Column | None = None
    low: int = 0
    high: int = 0
    needed: tuple[str, ...] = ()


def _fact(i: int, rule: Rule) -> Column:
    """What a row says to a rule: struct(rule, part, value), or null."""
    fact = lambda part, value: F.struct(F.lit(i).alias("rule"), part.cast("string").alias("part"), value.cast("string").alias("value"))
    nothing = F.lit(None)
    if rule.kind == "rows":
        return fact(F.lit(""), nothing)
    if rule.kind == "all_or_none":
        return fact(F.when(F.coalesce(rule.test, F.lit(False)), "given").otherwise("lacking"), nothing)
    if rule.kind == "row":
        return F.when(F.coalesce(rule.test, F.lit(False)), fact(F.lit(""), nothing))
    if rule.kind == "one_value":
        return F.when(rule.test.isNotNull() & rule.value.isNotNull(), fact(rule.test, rule.value))
    said = rule.test.isin(*rule.needed) if rule.kind == "needed" else rule.test.isNotNull()
    return F.when(said, fact(rule.test, nothing))


def broken_rules(df: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    """rule, n, first_key of every broken rule; nothing for a table that keeps its contract.

    n counts rows (row, rows, all_or_none: those that lack it) or values (unique, one_value, distinct, needed: those that
    are missing); first_key is the smallest key, as a string, of a row that breaks the rule, null where none can be
    named. Each row says what it has to say to all rules at once, so the table is read once; facts are added up by
    rule and group before they meet, and a rule without facts, as in an empty table, is judged too.
    """
    facts = df.select(F.col(key).alias("key"), F.inline(F.array_compact(F.array(*[_fact(i, r) for i, r in enumerate(rules)]))))
    groups = facts.groupBy("rule", "part").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.min("key").alias("key"))
    repeated, mixed, lacking = F.col("n") > 1, F.col("least") != F.col("most"), F.col("part") == "lacking"
    bounded = [i for i, r in enumerate(rules) if r.kind == "needed"]
    sums = groups.groupBy("rule").agg(
        F.sum("n").alias("rows"), F.count("*").alias("groups"), F.min("key").alias("key"),
        F.count_if(repeated).alias("repeated"), F.min(F.when(repeated, F.col("key"))).alias("repeated_key"),
        F.count_if(mixed).alias("mixed"), F.min(F.when(mixed, F.col("key"))).alias("mixed_key"),
        F.sum(F.when(lacking, F.col("n"))).alias("lacking"), F.min(F.when(lacking, F.col("key"))).alias("lacking_key"),
        F.collect_set(F.when(F.col("rule").isin(bounded or [-1]), F.col("part"))).alias("parts"),
    )
    listed = [(i, r.name, r.kind, r.low, r.high, list(r.needed)) for i, r in enumerate(rules)]
    named = df.sparkSession.createDataFrame(listed, "rule int, name string, kind string, low long, high long, needed array<string>")
    rows, values = F.coalesce("rows", F.lit(0)), F.coalesce("groups", F.lit(0))
    missing = F.size(F.array_except("needed", F.coalesce("parts", F.array().cast("array<string>"))))
    outside = lambda n: ~n.between(F.col("low"), F.col("high"))
    kinds = {
        "row": (rows > 0, rows, F.col("key")), "unique": (F.col("repeated") > 0, F.col("repeated"), F.col("repeated_key")), "one_value": (F.col("mixed") > 0, F.col("mixed"), F.col("mixed_key")),
        "rows": (outside(rows), rows, None), "distinct": (outside(values), values, None), "needed": (missing > 0, missing, None),
        "all_or_none": ((F.col("lacking") > 0) & (F.col("lacking") < F.col("rows")), F.col("lacking"), F.col("lacking_key")),
    }
    broken = n = first = None
    for kind, (test, number, name) in kinds.items():
        own = F.col("kind") == kind
        name = F.lit(None).cast("string") if name is None else name.cast("string")
        number = number.cast("long")
        broken, n, first = (F.when(own, x) if y is None else y.when(own, x) for x, y in ((test, broken), (number, n), (name, first)))
    return named.join(sums, "rule", "left").where(F.coalesce(broken, F.lit(False))).select(F.col("name").alias("rule"), n.alias("n"), first.alias("first_key"))


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _inside(boxes: Column, width: Column, height: Column, area: bool) -> Column:
    """All boxes are four finite numbers within the page; with an area, or without."""
    finite = lambda b: F.forall(b, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    ordered = lambda b: (b[0] < b[2]) & (b[1] < b[3]) if area else (b[0] <= b[2]) & (b[1] <= b[3])
    within = lambda x: F.forall(x["boxes"], lambda b: F.coalesce((F.size(b) == 4) & finite(b) & ordered(b) & (b[0] >= 0) & (b[1] >= 0) & (b[2] <= x["w"]) & (b[3] <= x["h"]), F.lit(False)))
    return F.coalesce(within(F.struct(boxes.alias("boxes"), width.alias("w"), height.alias("h"))), F.lit(False))


def receipt_rules(adapt: bool = True) -> list[Rule]:
    """VAL-08: rules of a manifest of receipts (schema, authorized, number_format_policy, currency, receipt_id, image, role, group_id); ``adapt`` for training, else inference only."""
    currency = (F.col("currency") == "unspecified") | F.col("currency").rlike(r"^\p{Lu}{3}$")
    rules = [
        Rule("schema", "row", ~_text("schema").isin(RECEIPT_SCHEMA)),
        Rule("not_authorized", "row", ~F.coalesce("authorized", F.lit(False))),
        Rule("number_format_policy", "row", ~_text("number_format_policy").isin(*POLICIES)),
        Rule("currency", "row", ~F.coalesce(currency, F.lit(False))),
        Rule("receipt_count", "rows", low=1, high=MOST_RECEIPTS),
        Rule("bad_receipt_id", "row", ~_text("receipt_id").rlike(RECEIPT_ID)),
        Rule("unsafe_image_path", "row", unsafe_path(F.col("image"))),
        Rule("image_type", "row", ~F.lower(_text("image")).rlike(r"\.(png|jpg|jpeg)$")),
        Rule("repeated_receipt_id", "unique", F.col("receipt_id")),
        Rule("repeated_image", "unique", F.col("image")),
    ]
    if not adapt:
        return [*rules, Rule("role", "row", F.coalesce("role", F.lit("inference")) != "inference")]
    return [
        *rules,
        Rule("role", "row", ~_text("role").isin(*ROLES)),
        Rule("no_group", "row", _text("group_id") == ""),
        Rule("group_in_two_roles", "one_value", F.col("group_id"), F.col("role")),
        Rule("missing_roles", "needed", F.col("role"), needed=NEEDED_ROLES),
    ]


def annotation_rules(fields: tuple[str, ...]) -> list[Rule]:
    """VAL-09: rules of annotated fields (receipt_id, field, status, parsed (of raw_value, see functions.amounts), canonical_value, value_boxes, width, height, provenance)."""
    present = F.col("status") == "present"
    return [
        Rule("unknown_field", "row", ~_text("field").isin(*fields)),
        Rule("status", "row", ~_text("status").isin("present", "not_annotated")),
        Rule("repeated_field", "unique", F.concat_ws("|", "receipt_id", "field")),
        Rule("unsupported_amount", "row", present & ~F.coalesce(F.col("parsed.parse_status") == "ok", F.lit(False))),
        Rule("contradictory_value", "row", present & (F.col("parsed.parse_status") == "ok") & F.col("canonical_value").isNotNull() & ~F.col("canonical_value").eqNullSafe(F.col("parsed.normalized_amount"))),
        Rule("value_boxes", "row", present & (F.coalesce(F.size("value_boxes") < 1, F.lit(True)) | ~_inside(F.col("value_boxes"), F.col("width"), F.col("height"), True))),
        Rule("no_provenance", "row", present & (_text("provenance") == "")),
    ]


def record_rules() -> list[Rule]:
    """VAL-10: rules of question records (id, page_id, file, question, words, boxes, width, height, answers)."""
    blank = lambda w: F.coalesce(w.rlike(f"^{SPACE}*$"), F.lit(True))
    asked = collapse(_text("question"))
    sides = F.col("width").between(*SIDES) & F.col("height").between(*SIDES)
    lacks = [F.col(c).isNull() for c in ("id", "page_id", "file", "question", "words", "boxes")]
    any_null = lacks[0]
    for x in lacks[1:]:
        any_null = any_null | x
    return [
        Rule("record_count", "rows", low=1, high=MOST_RECORDS),
        Rule("page_count", "distinct", F.col("file"), low=1, high=MOST_PAGES),
        Rule("missing_keys", "row", any_null),
        Rule("repeated_id", "unique", F.col("id")),
        Rule("question", "row", (asked == "") | (F.length(asked) > MOST_QUESTION)),
        Rule("image_size", "row", ~F.coalesce(sides, F.lit(False))),
        Rule("word_count", "row", ~F.coalesce(F.size("words").between(1, MOST_WORDS), F.lit(False))),
        Rule("blank_word", "row", F.exists("words", blank)),
        Rule("box_count", "row", F.size("words") != F.size("boxes")),
        Rule("box", "row", F.col("boxes").isNotNull() & ~_inside(F.col("boxes"), F.col("width"), F.col("height"), False)),
        Rule("answers", "row", F.col("answers").isNotNull() & ((F.size("answers") == 0) | F.exists("answers", blank))),
        Rule("answers_on_some", "all_or_none", F.col("answers").isNotNull()),
    ]
