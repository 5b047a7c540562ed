"""Review policies: threshold sweeps, selection, routing and what they cost (POL-*, WIN-06, TOP-04, TOP-05, CASE-01, CASE-02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import finite, rate, wilson

# Targets of the canonical policy.
TARGETS = {"min_accuracy": 0.95, "min_coverage": 0.50, "min_accepted": 25}


def hard_failure(status: Column, score: Column) -> Column:
    """FIL-05: why a total can never pass, null if it may."""
    return F.when(status != "ok", F.concat(F.lit("total_"), status)).when(~F.coalesce(finite(score), F.lit(False)), "total_score_unavailable")


def route(status: Column, score: Column, threshold: Column) -> tuple[Column, Column]:
    """CASE-01: (state, reason); a null threshold refers everything."""
    hard = hard_failure(status, score)
    reason = F.when(hard.isNotNull(), hard).when(threshold.isNull(), "refer_all_policy").when(score < threshold, "score_below_threshold")
    return F.when(reason.isNull(), "total_unflagged").otherwise("needs_review"), reason


def sweep(scored: DataFrame) -> DataFrame:
    """WIN-06: rows (system_id, parse_status, span_score, correct) of totals -> one row per system and observed score, and a refer_all row.

    correct is null where there is no usable reference; hard failures stay in the denominator. Scores are counted
    first; the running sums go over distinct scores only.
    """
    usable = scored.where(F.col("correct").isNotNull())
    totals = scored.groupBy("system_id").agg(F.count("correct").alias("scoreable"))
    eligible = usable.where(hard_failure(F.col("parse_status"), F.col("span_score")).isNull())
    counts = eligible.groupBy("system_id", F.col("span_score").alias("threshold")).agg(F.count("*").alias("k"), F.count_if("correct").alias("good"))
    down = Window.partitionBy("system_id").orderBy(F.desc("threshold"))
    rows = counts.select(
        "system_id", "threshold", F.sum("k").over(down).alias("accepted"), F.sum("good").over(down).alias("right"),
        (F.min("threshold").over(Window.partitionBy("system_id")) == F.col("threshold")).alias("lowest"),
    )
    seen = rows.join(totals, "system_id").withColumn("kind", F.when(F.col("lowest"), "accept_all_eligible").otherwise("observed_score"))
    none = totals.select("system_id", F.lit(None).cast("double").alias("threshold"), F.lit(0).cast("long").alias("accepted"), F.lit(0).cast("long").alias("right"), "scoreable", F.lit("refer_all").alias("kind"))
    return seen.drop("lowest").unionByName(none).select(
        "system_id", "kind", "threshold", "accepted", "scoreable", rate(F.col("accepted"), F.col("scoreable")).alias("coverage"),
        rate(F.col("right"), F.col("accepted")).alias("accuracy"), (F.col("accepted") - F.col("right")).alias("errors"),
    )


def select(swept: DataFrame, targets: dict = TARGETS) -> DataFrame:
    """POL-01, TOP-04: per system the feasible row with the most coverage, then the lowest error, then the highest threshold; else refer_all.

    Adds policy_feasible, the Wilson interval of the accuracy, and policy_id, a digest of the choice.
    """
    enough = F.col("threshold").isNotNull() & (F.col("accuracy") >= targets["min_accuracy"]) & (F.col("coverage") >= targets["min_coverage"]) & (F.col("accepted") >= targets["min_accepted"])
    merit = F.when(F.coalesce(enough, F.lit(False)), F.struct(F.lit(1).alias("f"), F.col("coverage").alias("c"), (-rate(F.col("errors"), F.col("accepted"))).alias("e"), F.col("threshold").alias("t")))
    merit = F.coalesce(merit, F.when(F.col("kind") == "refer_all", F.struct(F.lit(0).alias("f"), F.lit(0.0).alias("c"), F.lit(0.0).alias("e"), F.lit(0.0).alias("t"))))
    row = F.struct("kind", "threshold", "accepted", "scoreable", "coverage", "accuracy", "errors")
    best = swept.withColumn("merit", merit).where("merit is not null").groupBy("system_id").agg(F.max_by(row, "merit").alias("r"), F.max("merit.f").alias("feasible"))
    low, high = wilson(F.col("r.accepted") - F.col("r.errors"), F.col("r.accepted"))
    named = F.to_json(F.struct("system_id", F.col("r.threshold").alias("threshold"), F.col("r.kind").alias("kind"), *[F.lit(v).alias(k) for k, v in targets.items()]))
    return best.select("system_id", (F.col("feasible") == 1).alias("policy_feasible"), "r.*", low.alias("accuracy_low"), high.alias("accuracy_high"), F.sha2(named, 256).alias("policy_id"))


def coverage_point(swept: DataFrame, coverage: float) -> DataFrame:
    """POL-03, TOP-05: per system the highest threshold that reaches the coverage, else the lowest, else refer_all."""
    if not 0.05 <= coverage <= 1.0:
        raise ValueError("the coverage must be between 0.05 and 1.0")
    reached = F.max(F.when(F.col("coverage") >= coverage, F.col("threshold")))
    chosen = swept.groupBy("system_id").agg(reached.alias("hi"), F.min("threshold").alias("lo"))
    wanted = chosen.select("system_id", F.col("hi").isNotNull().alias("reached_requested"), F.coalesce("hi", "lo").alias("wanted"))
    return wanted.join(swept, "system_id").where(F.col("threshold").eqNullSafe(F.col("wanted"))).select(
        "system_id", F.lit(coverage).alias("requested_coverage"), "reached_requested", "threshold", "accepted", "scoreable", "coverage", "accuracy", "errors",
        F.when(F.col("threshold").isNull(), "refer_all").otherwise("coverage_operating_point").alias("selected_state"),
    )


def review_metrics(scored: DataFrame, policies: DataFrame) -> DataFrame:
    """POL-02: a frozen policy (system_id, threshold) applied to totals: coverage, selective error and review counts per system."""
    state, _ = route(F.col("parse_status"), F.col("span_score"), F.col("threshold"))
    routed = scored.join(F.broadcast(policies.select("system_id", "threshold")), "system_id").withColumn("open", state == "total_unflagged")
    hard = hard_failure(F.col("parse_status"), F.col("span_score")).isNotNull()
    sums = routed.groupBy("system_id").agg(
        F.count("*").alias("receipts"), F.count("correct").alias("usable"), F.count_if("open").alias("unflagged"),
        F.count_if(F.col("open") & F.col("correct").isNotNull()).alias("unflagged_scored"), F.count_if(F.col("open") & ~F.col("correct")).alias("unflagged_wrong"),
        F.count_if(hard).alias("hard_failures"),
    )
    low, high = wilson(F.col("unflagged_wrong"), F.col("unflagged_scored"))
    return sums.select(
        "*", rate(F.col("unflagged_scored"), F.col("usable")).alias("scored_coverage"), rate(F.col("unflagged_wrong"), F.col("unflagged_scored")).alias("selective_error"),
        low.alias("error_low"), high.alias("error_high"), rate(F.col("unflagged"), F.col("receipts")).alias("routing_coverage"),
        (F.col("unflagged") - F.col("unflagged_scored")).alias("unflagged_unscored"), (F.col("receipts") - F.col("unflagged")).alias("review_count"),
    )


def panel_category(correct: Column, status: Column, recoverable: Column) -> Column:
    """CASE-02: what a failure panel shows of a total; null without a usable reference."""
    return (
        F.when(correct.isNull(), F.lit(None).cast("string"))
        .when(correct, "success")
        .when(status.isin("failed", "no_candidate"), "failure_or_no_candidate")
        .when(status.isin("ambiguous", "unsupported"), "numeric_ambiguity")
        .when(recoverable, "extraction_error")
        .otherwise("ocr_loss")
    )


def first_per_category(rows: DataFrame, category: str, key: str, tag: str) -> DataFrame:
    """WIN-12, TOP-07: the first key of each category in hash order. An arg-min, so no category is sorted."""
    picked = rows.where(F.col(category).isNotNull()).groupBy(category)
    return picked.agg(F.min_by(key, F.sha2(F.concat(F.lit(f"{tag}|"), F.col(key).cast("string")), 256)).alias(key), F.count("*").alias("n"))


def first_keys(rows: DataFrame, category: str, key: str, tag: str, n: int) -> DataFrame:
    """TOP-08: category, place (from 1), key: the first n keys of each category in hash order.

    Spark limits each category to n rows in every task before it shuffles them, so a hot category is not sorted whole.
    """
    by = Window.partitionBy("category").orderBy(F.sha2(F.concat(F.lit(f"{tag}|"), F.col(key).cast("string")), 256))
    rows = rows.where(F.col(category).isNotNull()).select(F.col(category).alias("category"), key)
    return rows.withColumn("place", F.row_number().over(by)).where(F.col("place") <= n).select("category", "place", key)


def confident_wrong(scored: DataFrame) -> DataFrame:
    """TOP-07: system_id, receipt, span_score of the wrong answer with the greatest score; ties go to the smallest receipt."""
    wrong = scored.where("correct = false and span_score is not null and not isnan(span_score)")
    best = wrong.groupBy("system_id").agg(F.max(F.struct("span_score", (-F.col("receipt")).alias("r"))).alias("b"))
    return best.select("system_id", (-F.col("b.r")).alias("receipt"), "b.span_score")
