"""Scores of answers and systems (MET-*, AGG-*, BAS-*, CASE-03)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..functions.numbers import rate, wilson
from ..functions.text import common_prefix, content_words, last_number, normalize_answer, normalized_anls


def is_correct(state: Column, status: Column, predicted: Column, known: Column) -> Column:
    """MET-01: null unless the reference is usable; then the parse is ok and the amounts are equal."""
    return F.when(state == "present_usable", F.coalesce((status == "ok") & predicted.eqNullSafe(known), F.lit(False)))


def answer_metrics(rows: DataFrame, by: list[str]) -> DataFrame:
    """AGG-01, AGG-03: rows (prediction, anls, exact) -> by, n, anls, exact_match, empty_rate, enough (50 rows or more)."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("anls").alias("anls"), F.avg(F.col("exact").cast("int")).alias("exact_match"),
        F.avg((F.trim("prediction") == "").cast("int")).alias("empty_rate"), (F.count("*") >= 50).alias("enough"),
    )


def keyword_lookup(question: Column, words: Column, least: int = 3) -> Column:
    """STR-07, STR-08: the first word with a digit after the page word that shares the longest prefix with a content word.

    Ties go to the last such word; without one, or without a digit after it, the answer is the page's last number. All is
    done within the row: a page word is compared with the content words only if it shares its first ``least`` letters
    with one. Null questions and pages count as empty.
    """

    def answer(x: Column) -> Column:
        def shared(n: Column, at: Column) -> Column:
            longest = F.array_max(F.transform(x["asked"], lambda q: common_prefix(n, q)))
            return F.when(F.array_contains(x["starts"], F.left(n, F.lit(least))), F.struct(longest.alias("n"), at.alias("at")))

        def after(found: Column) -> Column:
            later = F.filter(x["words"], lambda w, i: (i > found["at"]) & w.rlike(r"\p{Nd}"))
            return F.coalesce(F.get(later, F.lit(0)), last_number(x["words"]))

        return let(F.array_max(F.transform(F.transform(x["words"], normalize_answer), shared)), after)

    asked = F.array_distinct(F.filter(content_words(question), lambda q: F.length(q) >= least))
    return let(asked, lambda q: let(F.struct(q.alias("asked"), F.array_distinct(F.transform(q, lambda w: F.left(w, F.lit(least)))).alias("starts"), F.coalesce(words, F.array().cast("array<string>")).alias("words")), answer))


def field_scores(predictions: DataFrame, references: DataFrame) -> DataFrame:
    """JON-05: predictions with their reference's state and correctness, one row per system, receipt and field."""
    known = references.withColumnRenamed("normalized_amount", "known")
    joined = predictions.join(known, ["receipt", "field"])
    return joined.withColumn("correct", is_correct(F.col("state"), F.col("parse_status"), F.col("normalized_amount"), F.col("known")))


def system_metrics(scored: DataFrame) -> DataFrame:
    """AGG-05: system_id, field, receipts, usable, correct, em, em_low, em_high, candidate_coverage, parse_coverage, unscored."""
    sums = scored.groupBy("system_id", "field").agg(
        F.count("*").alias("receipts"), F.count("correct").alias("usable"), F.count_if("correct").alias("correct"),
        F.count_if(F.coalesce("raw_text", F.lit("")) != "").alias("candidates"), F.count_if(F.col("parse_status") == "ok").alias("parsed"),
        F.count_if((F.col("state") == "not_annotated") & (F.col("parse_status") == "ok")).alias("unscored"),
    )
    low, high = wilson(F.col("correct"), F.col("usable"))
    return sums.select(
        "system_id", "field", "receipts", "usable", "correct", rate(F.col("correct"), F.col("usable")).alias("em"), low.alias("em_low"), high.alias("em_high"),
        rate(F.col("candidates"), F.col("receipts")).alias("candidate_coverage"), rate(F.col("parsed"), F.col("receipts")).alias("parse_coverage"), "unscored",
    )


def macro_em(metrics: DataFrame) -> DataFrame:
    """AGG-05: the mean of em over the fields that have usable references: system_id, field_macro_em, contributors."""
    return metrics.where("usable > 0").groupBy("system_id").agg(F.avg("em").alias("field_macro_em"), F.count("*").alias("contributors"))


def all_fields_match(scored: DataFrame) -> DataFrame:
    """AGG-05, AGG-21: of receipts with a usable total, the share whose usable fields are all correct: system_id, receipts, matching, share."""
    total = (F.col("field") == "total_amount") & F.col("correct").isNotNull()
    per = scored.groupBy("system_id", "receipt").agg(F.bool_or(total).alias("has_total"), F.coalesce(F.bool_and("correct"), F.lit(True)).alias("all"))
    sums = per.where("has_total").groupBy("system_id").agg(F.count("*").alias("receipts"), F.count_if("all").alias("matching"))
    return sums.withColumn("share", rate(F.col("matching"), F.col("receipts")))


def agreement(scored: DataFrame, first: str, second: str) -> DataFrame:
    """CASE-03, AGG-12, JON-06: how two systems agree on each field: field, category, n."""
    a = scored.where(F.col("system_id") == first).select("receipt", "field", F.coalesce("correct", F.lit(False)).alias("a"))
    b = scored.where(F.col("system_id") == second).select("receipt", "field", F.coalesce("correct", F.lit(False)).alias("b"))
    category = F.when(F.col("a") & F.col("b"), "both_exact").when(F.col("a"), f"{first}_only").when(F.col("b"), f"{second}_only").otherwise("neither_exact")
    return a.join(b, ["receipt", "field"]).groupBy("field", category.alias("category")).agg(F.count("*").alias("n"))


def crosstab(scored: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """AGG-08: counts of values per row, zero where there are none."""
    return scored.groupBy(row).pivot(column, values).count().na.fill(0)


def upper_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """AGG-09: by, n, upper_median (the element n // 2 of the sorted values), most.

    Values are counted first, so that only distinct values are sorted within a group.
    """
    from pyspark.sql.window import Window

    counts = rows.groupBy(by, value).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy(by).orderBy(value))
    n = F.sum("k").over(Window.partitionBy(by))
    marked = counts.select(by, F.col(value).alias("v"), upto.alias("upto"), n.alias("n"))
    return marked.groupBy(by).agg(F.max("n").alias("n"), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("v"))).alias("upper_median"), F.max("v").alias("most"))


# How an OCR run can end.
OCR_STATUSES = ("ok", "ocr_empty", "ocr_timeout", "ocr_error", "image_error")


def ocr_report(rows: DataFrame, by: str, most_words: int = 2000) -> DataFrame:
    """AGG-09: rows (by, status, n_tokens, cached) -> by, receipts, a count of each status, over_2000_words, median_words (upper), max_words, cache_hits."""
    counts = rows.groupBy(by).agg(
        F.count("*").alias("receipts"), *[F.count_if(F.col("status") == s).alias(s) for s in OCR_STATUSES],
        F.count_if(F.col("n_tokens") > most_words).alias("over_2000_words"), F.count_if("cached").alias("cache_hits"),
    )
    words = upper_median(rows, by, "n_tokens").select(F.col(by).alias("_by"), F.col("upper_median").alias("median_words"), F.col("most").alias("max_words"))
    return counts.join(words, counts[by].eqNullSafe(words["_by"])).drop("_by")


def uniform(*parts: Column) -> Column:
    """A number between 0 and 1, exclusive, from the SHA-256 of parts joined by bars: the same in every run and engine."""
    head = F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 13), 16, 10).cast("double")
    return (head + 0.5) / float(1 << 52)


#: A binomial variance from which the normal form is used, and the most that a smaller one reaches.
NORMAL_FROM, MOST_SMALL = 25.0, 150


def binomial(n: Column, p: Column, u: Column, v: Column) -> Column:
    """A draw from Binomial(n, p) by two uniform numbers; 0 for null p.

    Below a variance of NORMAL_FROM it is the inverse of the distribution function at u; from there on the normal form
    with its skewness, from u and v, which is off by less than a tenth of one count.
    """

    def drawn(x: Column) -> Column:
        n, q, flipped = x["n"], x["q"], x["flipped"]
        spread = n * q * (1 - q)
        start = F.struct(F.lit(0).cast("long").alias("k"), F.exp(n * F.log1p(-q)).alias("chance"), F.exp(n * F.log1p(-q)).alias("upto"))

        def step(a: Column, i: Column) -> Column:
            chance = F.when(i > n, F.lit(0.0)).otherwise(a["chance"] * (n - i + 1) / i * (q / (1 - q)))
            return F.struct((a["k"] + F.when((a["upto"] < x["u"]) & (i <= n), 1).otherwise(0)).cast("long").alias("k"), chance.alias("chance"), (a["upto"] + chance).alias("upto"))

        small = F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(MOST_SMALL).cast("long")), start, step, lambda a: a["k"])
        z = F.sqrt(-2 * F.ln(x["u"])) * F.cos(2 * F.pi() * x["v"])
        large = F.round(n * q + F.sqrt(spread) * z + (1 - 2 * q) * (z * z - 1) / 6).cast("long")
        k = F.when(spread < NORMAL_FROM, small).otherwise(F.greatest(F.lit(0).cast("long"), F.least(large, n)))
        return F.when(flipped, n - k).otherwise(k)

    share = F.coalesce(p, F.lit(0.0))
    return let(F.struct(n.cast("long").alias("n"), F.least(share, 1 - share).alias("q"), (share > 0.5).alias("flipped"), u.alias("u"), v.alias("v")), drawn)


def resampled_counts(counts: DataFrame, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """counts (one row: n, better, worse) -> k, n, better, worse of each resample, and seen_better, seen_worse of the sample itself.

    Drawing n rows with replacement and counting those of each kind is a multinomial draw; it is split into binomial
    ones, so each resample has exactly n rows, drawn in the same time however large n is.
    """
    u = lambda part, i: uniform(F.lit(seed), F.col("k"), F.lit(part), F.lit(i))
    rows = counts.select(F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("k"), "n", F.col("better").alias("seen_better"), F.col("worse").alias("seen_worse"))
    first = rows.withColumn("better", binomial(F.col("n"), F.try_divide(F.col("seen_better"), F.col("n")), u("better", 0), u("better", 1)))
    rest = binomial(F.col("n") - F.col("better"), F.try_divide(F.col("seen_worse"), F.col("n") - F.col("seen_better")), u("worse", 0), u("worse", 1))
    return first.select("k", "n", "better", rest.alias("worse"), "seen_better", "seen_worse")


def paired_bootstrap(scored: DataFrame, first: str, second: str, field: str, resamples: int = 2000, seed: int = 42) -> DataFrame:
    """MET-02: n, difference, low, high of em(first) - em(second), by resampling the receipts that both systems were scored on.

    A receipt counts by its difference, which is 1, 0 or -1, so a resample of n receipts is known by how many of each it
    has. Only these counts are drawn: the rows are read once, and nothing grows with receipts times resamples. Without
    receipts n is 0 and the rest is null.
    """
    pairs = scored.where((F.col("field") == field) & F.col("correct").isNotNull())
    pick = lambda s: F.max(F.when(F.col("system_id") == s, F.col("correct").cast("int")))
    d = pairs.groupBy("receipt").agg(pick(first).alias("a"), pick(second).alias("b")).where("a is not null and b is not null")
    counts = d.agg(F.count("*").alias("n"), F.count_if(F.col("a") > F.col("b")).alias("better"), F.count_if(F.col("a") < F.col("b")).alias("worse"))
    share = lambda b, w: F.try_divide((F.col(b) - F.col(w)).cast("double"), F.col("n"))
    drawn, seen = share("better", "worse"), share("seen_better", "seen_worse")
    return resampled_counts(counts, resamples, seed).agg(F.max("n").alias("n"), F.max(seen).alias("difference"), F.percentile(drawn, F.lit(0.025)).alias("low"), F.percentile(drawn, F.lit(0.975)).alias("high"))


def failure_reasons(rows: DataFrame) -> DataFrame:
    """AGG-05: rows (system_id, field, reasons) -> system_id, field, failure_reasons: how often each reason was given, as one string in the order of reasons; empty without any.

    A prediction may have several reasons or none. Reasons are counted before they meet in one row.
    """
    counts = rows.select("system_id", "field", F.explode_outer("reasons").alias("reason")).groupBy("system_id", "field", "reason").agg(F.count("*").alias("k"))
    parts = F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", F.col("k").cast("string").alias("k"))))
    said = F.array_join(F.transform(F.array_sort(parts), lambda x: F.concat_ws("=", x["reason"], x["k"])), "; ")
    return counts.groupBy("system_id", "field").agg(said.alias("failure_reasons"))


def system_report(scored: DataFrame) -> DataFrame:
    """AGG-05, AGG-19: system_id, field, usable, text_em, anls, prediction_states, states_on_usable, reference_states, verdict.

    scored: field_scores() with known_text, the reference as printed. Texts are scored on usable references only; the
    verdict says whether that is enough to measure. States are counted before they meet in one row. A column reason, null
    where there is none, gives failure_reasons as well, from the same counts.
    """
    given = [c for c in scored.columns if c == "reason"]
    usable = F.col("state") == "present_usable"
    texts = scored.select("system_id", "field", "parse_status", "state", *given, usable.alias("usable"), normalize_answer(F.col("raw_text")).alias("said"), normalize_answer(F.col("known_text")).alias("known"))
    same = F.when(F.col("usable"), (F.col("said") == F.col("known")).cast("int"))
    close = F.when(F.col("usable"), normalized_anls(F.col("said"), F.col("known")))
    rows = texts.select("system_id", "field", "parse_status", "state", *given, "usable", same.alias("same"), close.alias("close"))
    sums = rows.groupBy("system_id", "field", "parse_status", "state", *given).agg(F.count("*").alias("k"), F.count_if("usable").alias("u"), F.sum("same").alias("same"), F.sum("close").alias("close"))

    def counted(name: str, number: str) -> tuple[Column, Callable[[Column], Column]]:
        """Numbers by value, from the few rows of a system and field."""
        rows = F.collect_list(F.struct(F.col(name).alias("v"), F.col(number).alias("k")))

        def line(r: Column) -> Column:
            values = F.array_sort(F.array_distinct(F.transform(F.filter(r, lambda x: (x["k"] > 0) & x["v"].isNotNull()), lambda x: x["v"])))
            total = lambda v: F.aggregate(F.filter(r, lambda x: x["v"] == v), F.lit(0).cast("long"), lambda a, x: a + x["k"])
            return F.array_join(F.transform(values, lambda v: F.concat_ws("=", v, total(v).cast("string"))), "; ")

        return rows, line

    parts = {"prediction_states": counted("parse_status", "k"), "states_on_usable": counted("parse_status", "u"), "reference_states": counted("state", "k"), **({"failure_reasons": counted("reason", "k")} if given else {})}
    out = sums.groupBy("system_id", "field").agg(F.sum("u").alias("usable"), F.sum("same").alias("same"), F.sum("close").alias("close"), *[r.alias(n) for n, (r, _) in parts.items()])
    verdict = F.when(F.col("usable") == 0, "not-measurable").when(F.col("usable") >= 50, "measured").otherwise("measured-small-sample")
    return out.select(
        "system_id", "field", "usable", rate(F.col("same"), F.col("usable")).alias("text_em"), rate(F.col("close"), F.col("usable")).alias("anls"),
        *[let(F.col(n), line).alias(n) for n, (_, line) in parts.items()], verdict.alias("verdict"),
    )
