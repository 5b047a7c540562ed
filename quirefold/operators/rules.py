"""Keyword rules, amounts right of a key, and alignment with labelled regions (RUL-*, ALN-*, REF-01)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.amounts import DEFAULT_POLICY, LIKELY, MARKER, amount, is_amount, normalized
from ..functions.binding import let
from ..functions.geometry import clip, overlap_share, union_box
from ..functions.text import key_text, nfkc
from .pages import annotation
from .readers import LONGEST, window_count

GAP, LEAST_SHARE, MOST_WORDS = 1.5, 0.5, 4


def phrase_counts(tokens: DataFrame, ascii_only: bool = False) -> DataFrame:
    """AGG-10: printed keys of annotated lines as phrases: phrase, category, n. ascii_only: the words are known to be ASCII."""
    keys = tokens.where("is_key").withColumn("t", key_text(F.col("text"), ascii_only)).where("t <> ''")
    lines = keys.groupBy("receipt", "line", "category").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("w"))
    return lines.groupBy(F.array_join(F.transform("w", lambda x: x["t"]), " ").alias("phrase"), "category").agg(F.count("*").alias("n"))


def line_phrase_counts(lines: DataFrame) -> DataFrame:
    """phrase_counts() of lines (category, keys: the ASCII words of a line that are its printed key, in order), without gathering them."""
    phrase = F.array_join(F.filter(F.transform("keys", lambda t: key_text(t, True)), lambda t: t != ""), " ")
    return lines.groupBy(phrase.alias("phrase"), "category").agg(F.count("*").alias("n")).where("phrase <> ''")


def derive_keywords(counts: DataFrame, fields: dict[str, str], support: int = 3, purity: float = 0.8) -> DataFrame:
    """RUL-01, TOP-11: field, phrase, support, purity of phrases that mostly label a field's category; ties go to the smaller category."""
    best = counts.groupBy("phrase").agg(F.sum("n").alias("total"), F.min(F.struct((-F.col("n")).alias("m"), "category")).alias("b"))
    name = F.create_map(*[F.lit(x) for f, c in fields.items() for x in (c, f)])
    rows = best.select(F.element_at(name, F.col("b.category")).alias("field"), "phrase", (-F.col("b.m")).alias("support"), (-F.col("b.m") / F.col("total")).alias("purity"))
    return rows.where(F.col("field").isNotNull() & (F.col("support") / F.col("purity") >= support) & (F.col("purity") >= purity))


def token_lines(tokens: DataFrame, policy: str = DEFAULT_POLICY, ascii_only: bool = False) -> DataFrame:
    """receipt, lines: one row a receipt, with its lines in order as struct(line, words).

    A word has id (its place in the receipt), pos, text (NFKC), t (key text), box, confidence, ok (an amount) and mark (a
    currency marker). Words of the same place come in the order of their texts.
    """
    said = F.col("text") if ascii_only else nfkc(F.col("text"))
    read = tokens.withColumn("text", said)
    is_ok = F.when(F.col("text").rlike(LIKELY), amount(F.col("text"), policy)["parse_status"] == "ok").otherwise(F.lit(False))
    mark = F.coalesce(F.concat(F.trim("text"), F.lit(" ")).rlike(f"{MARKER}$"), F.lit(False))
    word = F.struct("line", "pos", "text", key_text(F.col("text"), ascii_only).alias("t"), "box", "confidence", is_ok.alias("ok"), mark.alias("mark"))
    rows = read.select("receipt", word.alias("word")).groupBy("receipt").agg(F.array_sort(F.collect_list("word")).alias("w"))

    def lined(w: Column) -> Column:
        numbered = F.transform(w, lambda x, i: x.withField("id", i))
        return let(numbered, lambda n: F.transform(F.array_distinct(F.transform(n, lambda x: x["line"])), lambda k: F.struct(k.alias("line"), F.filter(n, lambda x: x["line"] == k).alias("words"))))

    return rows.select("receipt", lined(F.col("w")).alias("lines"))


def phrase_hits(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """RUL-02, JON-12: receipt, hits: the non-overlapping key phrases of token_lines(), as struct(at, rank, start, end, field).

    Words meet the phrases by equality with their first word, and the words behind are then compared, so phrases may be
    of any length. Within a line (place ``at``) they are taken in the order of the catalogue (longer phrases, then more
    support, then field) and position unless a word is used already: a fold over the few candidates of a receipt.
    """
    parts = F.split("phrase", " ")
    rank = F.struct((-F.size(parts)).alias("n"), (-F.col("support")).alias("s"), "field", "phrase")
    book = rules.select(F.get(parts, F.lit(0)).alias("t"), parts.alias("parts"), rank.alias("rank"), "field")
    rows = lines.select("receipt", F.posexplode("lines").alias("at", "l")).select("receipt", "at", F.transform("l.words", lambda x: x["t"]).alias("w"))
    starts = rows.select("receipt", "at", F.posexplode(F.transform("w", lambda t, i: F.struct(t.alias("t"), F.slice(F.col("w"), i + 1, F.size("w")).alias("rest")))).alias("start", "x"))
    met = starts.select("receipt", "at", "start", "x.*").where("t <> ''").join(book, "t").where(F.slice("rest", F.lit(1), F.size("parts")) == F.col("parts"))
    hit = F.struct("at", "rank", "start", (F.col("start") + F.size("parts") - 1).alias("end"), "field")
    found = met.groupBy("receipt").agg(F.array_sort(F.collect_list(hit)).alias("c"))
    return found.select("receipt", _taken(F.col("c")).alias("hits"))


def _taken(candidates: Column) -> Column:
    """Of sorted candidates those that overlap none before them."""
    overlaps = lambda a, b: (a["at"] == b["at"]) & (a["start"] <= b["end"]) & (b["start"] <= a["end"])
    return F.aggregate(candidates, F.slice(candidates, 1, 0), lambda kept, x: F.when(F.exists(kept, lambda k: overlaps(k, x)), kept).otherwise(F.array_append(kept, x)))


#: Buckets of a phrase book, by a hash of the first word.
BUCKETS = 64


def phrase_book(rules: DataFrame) -> Column:
    """Key phrases as one value for all rows: an array of BUCKETS arrays of struct(parts, rank, field). A catalogue is small beside what it is matched with."""
    parts = F.split("phrase", " ")
    rank = F.struct((-F.size(parts)).alias("n"), (-F.col("support")).alias("s"), "field", "phrase")
    bucket = F.pmod(F.xxhash64(F.get(parts, F.lit(0))), F.lit(BUCKETS)).alias("bucket")
    own = rules.groupBy(bucket).agg(F.collect_list(F.struct(parts.alias("parts"), rank.alias("rank"), "field")).alias("phrases"))
    none = F.array().cast(own.schema["phrases"].dataType)
    found = own.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "phrases"))).alias("book"))
    return found.select(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BUCKETS - 1).cast("long")), lambda k: F.coalesce(F.element_at("book", k), none)).alias("book")).scalar()


def row_hits(lines: Column, book: Column) -> Column:
    """The hits of phrase_hits() within a row of lines (line, words of ASCII texts), by a phrase_book()."""

    def at_word(ts: Column, at: Column, t: Column, i: Column) -> Column:
        met = F.filter(F.get(book, F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int")), lambda p: (t != "") & (F.slice(ts, i + 1, F.size(p["parts"])) == p["parts"]))
        return F.transform(met, lambda p: F.struct(at.alias("at"), p["rank"].alias("rank"), i.alias("start"), (i + F.size(p["parts"]) - 1).alias("end"), p["field"].alias("field")))

    def on_line(line: Column, at: Column) -> Column:
        read = F.transform(line["words"], lambda w: F.coalesce(key_text(w["text"], True), F.lit("")))
        return let(read, lambda ts: F.flatten(F.transform(ts, lambda t, i: at_word(ts, at, t, i))))

    return let(F.array_sort(F.flatten(F.transform(lines, on_line))), _taken)


def amounts_right(words: Column, after: Column) -> Column:
    """RUL-03: the rightmost amount of a line's words behind place ``after``: struct(x1, o, ids, raw, confidences), the first of equals; null without one.

    A currency marker before it belongs to it, unless the marker stands directly behind that place.
    """

    def span(x: Column, i: Column) -> Column:
        before = F.get(words, i - 1)
        both = (i > after + 1) & F.coalesce(before["mark"], F.lit(False))
        one = lambda a, b: F.when(both, F.array(b, a)).otherwise(F.array(a))
        raw = F.when(both, F.concat_ws(" ", before["text"], x["text"])).otherwise(x["text"])
        found = F.struct(x["box"][2].alias("x1"), (-i).alias("o"), one(x["id"], before["id"]).alias("ids"), raw.alias("raw"), one(x["confidence"], before["confidence"]).alias("confidences"))
        return F.when((i > after) & x["ok"], found)

    return F.array_max(F.transform(words, span))


def rule_extract(tokens: DataFrame, rules: DataFrame, fields: list[str], policy: str = DEFAULT_POLICY, ascii_only: bool = False, failures: DataFrame | None = None) -> DataFrame:
    """RUL-04, PRJ-04: receipt, field, parse_status, raw_text, normalized_amount, span_score, reasons, token_ids, key_token_ids, candidate_count, candidate_token_ids.

    From each key phrase the rightmost amount on its line, else on the next line if that is near enough. The best
    phrase's amount counts, same line before next; distinct amounts at the best rank are ambiguous, and their spans are
    listed as candidate_token_ids. The score is the least confidence of the words used, null unless all of them are
    from 0 to 100. failures (receipt, failure) lists documents that were refused: their fields are failed, for that
    reason. All words of a receipt are in one row; texts are NFKC unless they are known to be ASCII.
    """
    lines = token_lines(tokens, policy, ascii_only)
    out = extracted(lines.join(phrase_hits(lines, rules), "receipt", "left"), fields, policy)
    if failures is None:
        return out
    none = F.array().cast("array<int>")
    refused = failures.select("receipt", "failure", F.explode(F.array(*map(F.lit, fields))).alias("field"))
    empty = {"parse_status": F.lit("failed"), "reasons": F.array("failure"), "token_ids": none, "key_token_ids": none, "candidate_count": F.lit(0), "candidate_token_ids": F.array().cast("array<array<int>>")}
    failed = refused.select(*[empty.get(c, F.col(c) if c in ("receipt", "field") else F.lit(None).cast(out.schema[c].dataType)).alias(c) for c in out.columns])
    return out.join(failures.select("receipt"), "receipt", "left_anti").unionByName(failed)


def spelled_words(lines: Column, at: Column, box: Callable[[Column, Column], Column], confidence: Callable[[Column, Column], Column], policy: str = DEFAULT_POLICY) -> Column:
    """The words of the line at a place of lines (line, words of struct(pos, text)) with what token_lines() tells of them but t, for ASCII texts."""
    first = F.aggregate(F.slice(lines, F.lit(1), at), F.lit(0), lambda n, x: n + F.size(x["words"]))

    def word(line: Column, w: Column, i: Column) -> Column:
        is_ok = F.when(w["text"].rlike(LIKELY), is_amount(w["text"], policy)).otherwise(F.lit(False))
        mark = F.coalesce(F.concat(F.trim(w["text"]), F.lit(" ")).rlike(f"{MARKER}$"), F.lit(False))
        return F.struct(w["text"].alias("text"), box(line, w).alias("box"), confidence(line, w).alias("confidence"), is_ok.alias("ok"), mark.alias("mark"), (first + i).alias("id"))

    return let(F.get(lines, at), lambda line: F.transform(line["words"], lambda w, i: word(line, w, i)))


def extracted(rows: DataFrame, fields: list[str], policy: str = DEFAULT_POLICY, words_at: Callable[[Column], Column] = lambda at: F.get(F.col("lines"), at)["words"], keep: tuple[str, ...] = ()) -> DataFrame:
    """rule_extract() of rows (receipt, lines, hits), with their columns keep; words_at(place) gives the words of a line, which few lines are asked for."""

    def judged(h: Column) -> Column:
        return let(words_at(h["at"]), lambda words: on_line(h, words))

    def on_line(h: Column, words: Column) -> Column:
        key = F.slice(words, h["start"] + 1, h["end"] - h["start"] + 1)
        side = lambda w, i, f: f(F.transform(w, lambda x: x["box"][i]))

        def below(under: Column) -> Column:
            top, bottom = side(key, 1, F.array_min), side(key, 3, F.array_max)
            drop = side(under, 1, F.array_min) - bottom
            return F.when((drop >= 0) & (drop <= GAP * (bottom - top)), amounts_right(under, F.lit(-1)))

        def chosen(own: Column) -> Column:
            level = F.when(own.isNotNull(), 0).otherwise(1)
            span = F.coalesce(own, let(words_at(h["at"] + 1), below))
            return let(span, lambda x: F.when(x.isNotNull(), found(x, level)))

        def found(x: Column, level: Column) -> Column:
            used = F.concat(F.transform(key, lambda k: k["confidence"]), x["confidences"])
            sure = F.forall(used, lambda c: c.isNotNull() & ~F.isnan(c) & c.between(0, 100))
            return F.struct(
                F.struct(h["rank"].alias("rank"), level.alias("level")).alias("rank"), h["at"].alias("at"), h["start"].alias("start"), h["field"].alias("field"), x["raw"].alias("raw"),
                normalized(x["raw"], policy).alias("value"), F.when(sure, F.array_min(used) / 100).alias("score"), x["ids"].alias("ids"), F.transform(key, lambda k: k["id"]).alias("key_ids"),
            )

        return let(amounts_right(words, h["end"]), chosen)

    picked = rows.select("receipt", *keep, F.filter(F.transform("hits", judged), lambda x: x.isNotNull()).alias("picked"))
    none = F.array().cast("array<int>")

    def field_result(field: str) -> Column:
        own = F.coalesce(F.filter("picked", lambda x: x["field"] == field), F.filter(F.col("picked"), lambda x: F.lit(False)))

        def best(c: Column) -> Column:
            return let(F.array_min(F.transform(c, lambda x: x["rank"])), lambda top: let(F.filter(c, lambda x: x["rank"] == top), lambda tied: let(F.get(F.array_sort(tied), F.lit(0)), lambda f: result(c, tied, f))))

        def result(c: Column, tied: Column, f: Column) -> Column:
            split = F.size(F.array_distinct(F.transform(tied, lambda x: x["value"]))) > 1
            ok = f.isNotNull() & ~split
            status = F.when(f.isNull(), "no_candidate").when(split, "ambiguous").otherwise("ok")
            reason = F.when(f.isNull(), "no_keyword_amount").when(split, "tied_distinct_candidates")
            return F.struct(
                F.lit(field).alias("field"), status.alias("parse_status"), F.when(ok, f["raw"]).alias("raw_text"), F.when(ok, f["value"]).alias("normalized_amount"), F.when(ok, f["score"]).alias("span_score"),
                F.when(reason.isNull(), F.array().cast("array<string>")).otherwise(F.array(reason)).alias("reasons"), F.when(ok, f["ids"]).otherwise(none).alias("token_ids"), F.when(ok, f["key_ids"]).otherwise(none).alias("key_token_ids"),
                F.coalesce(F.size(c), F.lit(0)).alias("candidate_count"), F.when(split, F.transform(tied, lambda x: x["ids"])).otherwise(F.array().cast("array<array<int>>")).alias("candidate_token_ids"),
            )

        return let(own, best)

    return picked.select("receipt", *keep, F.inline_outer(F.array(*map(field_result, fields))))


def align(tokens: DataFrame, regions: DataFrame, policy: str = DEFAULT_POLICY) -> DataFrame:
    """ALN-01, ALN-03, ARR-05, ARR-06, JON-11: receipt, field, status, start, end of the OCR span that shows a reference.

    regions: receipt, field, state, normalized_amount, boxes. Spans are runs of up to four words of one line that parse
    to the reference's amount and whose box lies at least half inside one of its regions; of nested spans the smaller
    stays. One span is aligned, more are ambiguous_alignment, none is target_not_recoverable_from_ocr; a reference that
    is not usable gives no_usable_reference.
    """
    words = F.array_sort(F.collect_list(F.struct("pos", "text", "box"))).alias("words")
    lines = tokens.groupBy("receipt", "line").agg(words).groupBy("receipt").agg(F.array_sort(F.collect_list(F.struct("line", "words"))).alias("lines"))
    wanted = regions.groupBy("receipt").agg(F.collect_list(F.struct("field", "state", "normalized_amount", "boxes")).alias("regions"))
    found = aligned(F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)), F.col("regions"), policy)
    return wanted.join(lines, "receipt", "left").select("receipt", F.inline_outer(found)).where("status is not null").select("receipt", "field", "status", "spans", "line", "start", "end")


def aligned(lines: Column, regions: Column, policy: str = DEFAULT_POLICY, box: Callable[[Column, Column], Column] = lambda line, word: word["box"]) -> Column:
    """align() within a row: an array of struct(field, state, status, spans, line, start, end), one for each region.

    lines: array of struct(line, words), words of struct(text, ...) whose box is box(line, word); regions: array of
    struct(field, state, normalized_amount, boxes). A run has its amount's digits in one word, as amounts hold no space:
    lines where no word has the digits of a region's amount have no span, and are left before any run is spelled out.
    """
    digits = lambda c: F.translate(c, ".,", "")
    usable = lambda r: r["state"] == "present_usable"

    def shows(line: Column, wanted: Column) -> Column:
        return F.exists(F.transform(line["words"], lambda w: digits(w["text"])), lambda x: F.exists(wanted, lambda d: F.contains(x, d)))

    def spelled(line: Column) -> Column:
        w = line["words"]

        def run(i: Column, n: Column) -> Column:
            part = F.slice(w, i + 1, n)
            return F.struct(line["line"].alias("line"), i.alias("start"), (i + n - 1).alias("end"), part.alias("part"), F.array_join(F.transform(part, lambda x: x["text"]), " ").alias("said"))

        return F.flatten(F.transform(w, lambda _, i: F.transform(F.sequence(F.lit(1), F.least(F.lit(MOST_WORDS), F.size(w) - i)), lambda n: run(i, n))))

    def read(run: Column) -> Column:
        at = let(F.transform(run["part"], lambda w: box(run["line"], w)), union_box)
        return F.struct(F.struct(run["line"].alias("line"), run["start"].alias("start"), run["end"].alias("end")).alias("span"), at.alias("at"), normalized(run["said"], policy).alias("value"))

    def nested(a: Column, b: Column) -> Column:
        return (a["line"] == b["line"]) & (a["start"] <= b["start"]) & (b["end"] <= a["end"]) & (b != a)

    def judged(r: Column, runs: Column) -> Column:
        own = F.filter(runs, lambda x: usable(r) & (x["value"] == r["normalized_amount"]) & F.exists(r["boxes"], lambda b: overlap_share(x["at"], b) >= LEAST_SHARE))
        return let(F.transform(own, lambda x: x["span"]), lambda s: let(F.filter(s, lambda a: ~F.exists(s, lambda b: nested(a, b))), lambda least: result(r, least)))

    def result(r: Column, s: Column) -> Column:
        n = F.size(s)
        only = F.when(n == 1, F.get(s, F.lit(0)))
        status = F.when(~usable(r), "no_usable_reference").when(n == 0, "target_not_recoverable_from_ocr").when(n == 1, "aligned").otherwise("ambiguous_alignment")
        return F.struct(
            r["field"].alias("field"), r["state"].alias("state"), status.alias("status"), n.alias("spans"), only["line"].alias("line"), only["start"].alias("start"), only["end"].alias("end")
        )

    def spans(asked: Column) -> Column:
        wanted = F.transform(F.filter(asked, usable), lambda r: digits(r["normalized_amount"]))
        some = let(wanted, lambda d: F.filter(lines, lambda line: shows(line, d)))
        likely = F.filter(F.flatten(F.transform(some, spelled)), lambda run: run["said"].rlike(LIKELY))  # before the costly parts
        return let(F.transform(likely, read), lambda runs: F.transform(asked, lambda r: judged(r, runs)))

    return let(regions, spans)


def recoverability(state: Column, ocr_status: Column, alignment: Column) -> Column:
    """ALN-03: whether the right amount can be found in the OCR words at all."""
    return (
        F.when(state != "present_usable", "not_scoreable")
        .when(ocr_status != "ok", "not_recoverable")
        .when(alignment == "aligned", "recoverable")
        .when(alignment == "ambiguous_alignment", "recoverable_ambiguous")
        .otherwise("not_recoverable")
    )


def reference_states(rows: DataFrame, key: str, text: str, fields: dict[str, str], width: int, height: int, policy: str = DEFAULT_POLICY) -> DataFrame:
    """REF-01, JSN-02: key, field, state, reason, normalized_amount, n_lines from JSON annotations.

    In this order: a page size other than the image's makes all fields invalid; conflicting groups under an old and a
    new name are ambiguous; a field on no line is not annotated, or ambiguous if only the parsed part has it; words
    without a box make it invalid; value words must be amounts that agree on all lines; and the parsed part, a string or
    a list of strings, must agree with them.
    """
    doc = rows.select(key, annotation(F.col(text)).alias("d")).select(key, "d.*")
    size = F.col("meta.image_size")
    fits = F.coalesce((size["width"] == width) & (size["height"] == height), F.lit(False))

    def side(quad: Column, a: str) -> Column:
        return F.array(*[quad[f"{a}{i}"] for i in range(1, 5)])

    def judged(line: Column) -> Column:
        words = F.filter(line["words"], lambda w: F.trim(w["text"]) != "")
        value = F.filter(words, lambda w: w["is_key"] == 0)
        bad = F.exists(words, lambda w: clip(side(w["quad"], "x"), side(w["quad"], "y"), F.lit(width), F.lit(height)).isNull())
        said = F.array_join(F.transform(value, lambda w: w["text"]), " ")
        return F.struct(alias(line).alias("category"), (bad | (F.size(value) == 0)).alias("bad"), amount(said, policy).alias("a"))

    def alias(line: Column) -> Column:
        return F.regexp_replace(line["category"], r"^subtotal(?=\.|$)", "sub_total")

    wanted = F.filter("valid_line", lambda line: alias(line).isin(*fields.values()))
    doc = doc.select(key, fits.alias("fits"), "gt_parse", F.transform(wanted, judged).alias("lines"))

    def parsed(category: str) -> Column:
        group, leaf = category.split(".")
        own = F.try_variant_get("gt_parse", f"$.{group}", "variant")
        old = F.try_variant_get("gt_parse", "$.subtotal", "variant") if group == "sub_total" else F.lit(None).cast("variant")
        clash = own.isNotNull() & old.isNotNull() & (F.to_json(own) != F.to_json(old))
        value = F.try_variant_get(F.coalesce(own, old), f"$.{leaf}", "variant")
        kind = F.schema_of_variant(value)
        items = F.when(kind == "STRING", F.array(F.try_variant_get(value, "$", "string"))).when(kind == "ARRAY<STRING>", F.try_variant_get(value, "$", "array<string>"))
        own_lines = F.filter("lines", lambda x: x["category"] == category)
        return F.struct(F.lit(category).alias("category"), F.coalesce(clash, F.lit(False)).alias("clash"), value.isNotNull().alias("given"), items.alias("items"), own_lines.alias("own"))

    cells = doc.select(key, "fits", F.explode(F.array(*map(parsed, fields.values()))).alias("g")).select(key, "fits", "g.*")
    found = F.transform("own", lambda x: x["a"]["normalized_amount"])
    cells = cells.select(
        key, "fits", "category", "clash", "given", "items", F.transform("items", lambda i: amount(i, policy)["normalized_amount"]).alias("p"), F.size("own").alias("n_lines"),
        F.exists("own", lambda x: x["bad"]).alias("bad"), F.exists("own", lambda x: x["a"]["parse_status"] != "ok").alias("unparsed"), F.array_min(found).alias("lo"), F.array_max(found).alias("hi"),
    )
    same = F.forall("p", lambda v: v.eqNullSafe(F.col("lo")))
    checks = [
        (~F.col("fits"), "invalid_reference", "annotation_image_size_mismatch"),
        (F.col("clash"), "ambiguous_reference", "sub_total_alias_conflict"),
        ((F.col("n_lines") == 0) & ~F.col("given"), "not_annotated", None),
        (F.col("n_lines") == 0, "ambiguous_reference", "gt_parse_without_value_words"),
        (F.col("bad"), "invalid_reference", "invalid_or_missing_value_words"),
        (F.col("unparsed"), "ambiguous_reference", "unparseable_source_value"),
        (F.col("lo") != F.col("hi"), "ambiguous_reference", "multiple_incompatible_values"),
        (F.col("given") & F.col("items").isNull(), "ambiguous_reference", "structured_gt_parse_value"),
        (F.col("given") & ~same, "ambiguous_reference", "gt_parse_value_word_disagreement"),
    ]
    state = reason = None
    for test, name, why in checks:
        why = F.lit(why).cast("string")
        state = F.when(test, name) if state is None else state.when(test, name)
        reason = F.when(test, why) if reason is None else reason.when(test, why)
    state = state.otherwise("present_usable")
    field = F.element_at(F.create_map(*[F.lit(x) for f, c in fields.items() for x in (c, f)]), F.col("category"))
    return cells.select(key, field.alias("field"), state.alias("state"), reason.alias("reason"), F.when(state == "present_usable", F.col("lo")).alias("normalized_amount"), F.col("n_lines").cast("long").alias("n_lines"))


def training_examples(aligned: DataFrame, fields: list[str], most: int = 4, n_question: int = 12, longest: int = LONGEST) -> DataFrame:
    """ALN-02: aligned (receipt, field, state, status, line, start, end, n_tokens, and n_answer if known) -> the same with outcome.

    outcome is aligned for an example; else the reference's state, why the alignment failed, training_window_limit for a
    receipt that needs more than one window, answer_token_limit for an answer of no token or more than ``longest``
    (n_answer), or per_receipt_ceiling behind the first ``most`` examples of a receipt, in
    the order of fields. line, start and end are null without an example.
    """
    names = ["field", "state", "status", "line", "start", "end", "n_tokens", *[c for c in aligned.columns if c == "n_answer"]]
    rows = aligned.groupBy("receipt").agg(F.collect_list(F.struct(*names)).alias("rows"))  # a receipt has few fields
    examples = receipt_examples(F.col("rows"), fields, most, n_question, longest, "n_answer" in names)
    return rows.select("receipt", F.inline_outer(examples)).where("outcome is not null")


def receipt_examples(rows: Column, fields: list[str], most: int = 4, n_question: int = 12, longest: int = LONGEST, counted: bool = False) -> Column:
    """training_examples() of one receipt from an array of its fields: an array of struct(field, outcome, line, start, end). counted: they have n_answer."""

    def row(x: Column) -> Column:
        why = F.when(x["state"] != "present_usable", x["state"]).when(x["status"] != "aligned", x["status"])
        why = why.when(window_count(F.lit(n_question), x["n_tokens"]) != 1, "training_window_limit")
        if counted:
            why = why.when(~F.coalesce(x["n_answer"].between(1, longest), F.lit(False)), "answer_token_limit")
        order = F.array_position(F.array(*map(F.lit, fields)), x["field"])
        return F.struct(order.alias("order"), x["field"].alias("field"), why.otherwise("aligned").alias("why"), *[x[c].alias(c) for c in ("line", "start", "end")])

    def outcome(x: Column, before: Column) -> Column:
        late = (x["why"] == "aligned") & (F.size(F.filter(before, lambda y: y["why"] == "aligned")) >= most)
        said = F.when(late, "per_receipt_ceiling").otherwise(x["why"])
        shown = [F.when(said == "aligned", x[c]).alias(c) for c in ("line", "start", "end")]
        return F.struct(x["field"].alias("field"), said.alias("outcome"), *shown)

    return let(F.array_sort(F.transform(rows, row)), lambda r: F.transform(r, lambda x, i: outcome(x, F.slice(r, F.lit(1), i))))


def reading_order(tokens: DataFrame) -> DataFrame:
    """TOP-12: receipt, line, pos, row, place: lines by their top and left, the words of a line by left and top."""
    word = F.struct(F.col("box")[0].alias("x"), F.col("box")[1].alias("y"), "pos")
    lines = tokens.groupBy("receipt", "line").agg(F.min(F.col("box")[1]).alias("top"), F.min(F.col("box")[0]).alias("left"), F.array_sort(F.collect_list(word)).alias("words"))
    pages = lines.groupBy("receipt").agg(F.array_sort(F.collect_list(F.struct("top", "left", "line", "words"))).alias("lines"))
    rows = pages.select("receipt", F.posexplode("lines").alias("row", "l"))
    return rows.select("receipt", "l.line", "row", F.posexplode("l.words").alias("place", "w")).select("receipt", "line", "w.pos", "row", "place")
