"""Validation as violation rows (VAL-*): an input is accepted if the query returns nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.text import SPACE, collapse

ID = r"^[A-Za-z0-9_.:-]{1,64}$"
MOST_WORDS, MOST_SIDE, MOST_QUESTION = 2000, 10_000, 256


def first_violation(checks: list[tuple[Column, str]]) -> Column:
    """The name of the first check that is true, null if none is. Nulls in a check count as false."""
    start = F.when(F.coalesce(checks[0][0], F.lit(False)), checks[0][1])
    return reduce(lambda w, c: w.when(F.coalesce(c[0], F.lit(False)), c[1]), checks[1:], start)


def document_violation(words: Column, boxes: Column, width: Column, height: Column) -> Column:
    """VAL-01, VAL-02: why a page's words and boxes are refused; boxes without area are allowed.

    Words and boxes are bound once per row. The page's sides are compared with the extremes of all boxes, outside the
    functions over single boxes: Spark would evaluate an outer expression again for each of them.
    """

    def judged(x: Column) -> Column:
        words, boxes = x["words"], x["boxes"]
        shaped = F.coalesce(F.forall(boxes, lambda b: (F.size(b) == 4) & (b[0] <= b[2]) & (b[1] <= b[3])), F.lit(False))
        side = lambda i, f: f(F.transform(boxes, lambda b: b[i]))  # noqa: E731  NaN is the largest number
        inside = (side(0, F.array_min) >= 0) & (side(1, F.array_min) >= 0) & (side(2, F.array_max) <= width) & (side(3, F.array_max) <= height)
        bad_side = ~width.between(1, MOST_SIDE) | ~height.between(1, MOST_SIDE)
        return first_violation([
            (words.isNull() | (F.size(words) == 0), "no_words"),
            (F.size(words) > MOST_WORDS, "too_many_words"),
            (F.exists(words, lambda w: w.rlike(f"^{SPACE}*$")), "blank_word"),
            (bad_side, "bad_image_size"),
            (F.size(words) != F.size(boxes), "box_count"),
            (~shaped | ~inside, "bad_box"),
        ])

    return let(F.struct(words.alias("words"), boxes.alias("boxes")), judged)


def question_violation(question: Column) -> Column:
    """VAL-03: a question is 1 to 256 characters after collapsing white space."""
    return let(
        collapse(F.coalesce(question, F.lit(""))),
        lambda text: first_violation([(text == "", "blank_question"), (F.length(text) > MOST_QUESTION, "long_question")]),
    )


def record_violation(words: Column, start: Column, end: Column, answer: Column, record_id: Column) -> Column:
    """VAL-05: id grammar, span inside the words, and the answer equal to the span's text."""
    text = F.array_join(F.slice(words, F.greatest(start, F.lit(0)) + 1, F.greatest(end - start + 1, F.lit(0))), " ")
    return first_violation([
        (~record_id.rlike(ID), "bad_id"),
        ((start < 0) | (end < start) | (end >= F.size(words)), "span_outside"),
        (text != answer, "answer_mismatch"),
    ])


def receipt_failure(n_tokens: Column, n_blank: Column, n_bad_box: Column, status: Column) -> Column:
    """VAL-07: a receipt's failure code, null if it is usable."""
    return F.when(status != "ok", status).otherwise(
        first_violation([(n_tokens == 0, "ocr_empty"), (n_tokens > MOST_WORDS, "input_limit_exceeded"), (n_blank > 0, "blank_token"), (n_bad_box > 0, "invalid_geometry")])
    )


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """VAL-06: ids that occur more than once, with their count."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def crossing_groups(df: DataFrame, group: str, role: str) -> DataFrame:
    """VAL-08: groups whose members have more than one role."""
    return df.groupBy(group).agg(F.array_sort(F.collect_set(role)).alias("roles")).where(F.size("roles") > 1).select(group, F.array_join("roles", ",").alias("roles"))


def all_or_none(df: DataFrame, group: str, value: Column) -> DataFrame:
    """VAL-10, AGG-21: per group the counts of present and all values, and whether all or none are present."""
    counts = df.groupBy(group).agg(F.count(value).alias("present"), F.count("*").alias("n"))
    return counts.withColumn("consistent", F.col("present").isin(0) | (F.col("present") == F.col("n")))


def unsafe_path(path: Column) -> Column:
    """VAL-13: a relative path that is empty, absolute, has a drive, a backslash or a .. step."""
    steps = F.split(path, "/")
    return path.isNull() | (path == "") | path.startswith("/") | path.contains("\\") | path.contains(":") | F.exists(steps, lambda s: s.isin("", ".", ".."))


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """JON-03, SET-03: keys of only one side: key, side (left or right)."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("right")))


def manifest_conflicts(data: DataFrame, split: DataFrame, key: str, role: str) -> DataFrame:
    """JON-01, SRC-22: rows that are not one to one between two manifests, or whose roles differ: key, problem."""
    a, b = data.select(key, F.col(role).alias("_a")), split.select(key, F.col(role).alias("_b"))
    both = a.join(b, key, "full_outer")
    problem = F.when(F.col("_a").isNull(), "only_in_split").when(F.col("_b").isNull(), "only_in_data").when(F.col("_a") != F.col("_b"), "role_differs")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def annotation_violation(status: Column, raw: Column, canonical: Column, parsed: Column) -> Column:
    """VAL-09: a user's annotation: known status, a raw value that parses, and a canonical value that agrees with it."""
    amount = parsed["parse_status"] == "ok"
    return first_violation([
        (~status.isin("present", "absent"), "unknown_status"),
        ((status == "absent") & (raw.isNotNull() | canonical.isNotNull()), "absent_with_value"),
        ((status == "present") & raw.isNull(), "present_without_value"),
        ((status == "present") & ~amount, "unparseable"),
        ((status == "present") & canonical.isNotNull() & (canonical != parsed["normalized_amount"]), "contradictory"),
    ])


def mixed_runs(rows: DataFrame, run: str, identity: list[str]) -> DataFrame:
    """VAL-17: runs whose rows do not share one identity (code, controls, test set): run, identities."""
    return rows.groupBy(run).agg(F.countDistinct(F.struct(*identity)).alias("identities")).where("identities > 1")


def check_range(name: str, value: float, low: float, high: float) -> float:
    """VAL-11: a control inside its range, NaN excluded; for the driver."""
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}")
    return value


def record_bounds(n: Column, least: int = 8, most: int = 20_000) -> Column:
    """VAL-06: whether a dataset has as many records as are allowed."""
    return n.between(least, most)
