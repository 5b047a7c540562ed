"""Views of the driver's tables in the shape of annotated receipts, pages, predictions and scores.

Every view is a deterministic expression over whole tables, so that it can be restated in SQL (see plans/oracles.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.binding import let
from ..functions.text import words

FIELDS = ("subtotal_amount", "tax_amount", "total_amount")
# Line categories of the fields.
CATEGORY = {"subtotal_amount": "sub_total.subtotal_price", "tax_amount": "sub_total.tax_price", "total_amount": "total.total_price"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grouped(value: Column, style: Column) -> Column:
    """An integer as text: style 0 with points, 1 with commas, 2 plain digits."""
    commas = F.format_number(value, 0)
    return F.when(style == 0, F.translate(commas, ",", ".")).when(style == 1, commas).otherwise(value.cast("string"))


def receipt_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: one row per order that has line items: receipt, owner, status, n_items, style, subtotal, tax, total, items (array, in line order)."""
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("receipt")).agg(
        F.sum(F.floor("l_extendedprice").cast("long")).alias("subtotal"), F.count("*").alias("n_items"), F.array_sort(F.collect_list(item)).alias("items")
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("receipt"), F.col("o_custkey").alias("owner"), F.col("o_orderstatus").alias("status")
    )
    return orders.join(lines, "receipt").select(
        "receipt", "owner", "status", "n_items", (F.col("receipt") % 3).alias("style"), "subtotal",
        F.floor(F.col("subtotal") / 10).alias("tax"), (F.col("subtotal") + F.floor(F.col("subtotal") / 10)).alias("total"), "items",
    )


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """receipt_documents() without the items."""
    return receipt_documents(spark, sf_dir).drop("items")


def lined_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: receipt_documents() with lines, an array of struct(line, category, group_id, words, n_key (leading words that are a printed key)).

    Items come first (one line each, numbered from 1), then subtotal, tax, total and, on every fifth receipt, a second
    total line. Keys and amounts vary by receipt, so that some lines mislead. All lines of a receipt come from its row.
    """

    def row(line: Column, category: str, group: Column, words: Column, n_key: Column) -> Column:
        return F.struct(line.cast("int").alias("line"), F.lit(category).alias("category"), group.cast("int").alias("group_id"), words.alias("words"), n_key.cast("int").alias("n_key"))

    def item(x: Column, i: Column) -> Column:
        price = grouped(F.floor(x["l_extendedprice"]).cast("long"), F.col("style"))
        words = F.array(F.concat(F.lit("P"), x["l_partkey"].cast("string")), F.lit("x"), x["l_quantity"].cast("int").cast("string"), price)
        return row(i + 1, "menu.nm", i + 1, words, F.lit(0))

    def foot(at: int, category: str, key: Column, value: Column) -> Column:
        return row(F.lit(100 + at), category, F.lit(100), F.concat(key, value), F.size(key))

    r, text = F.col("receipt"), lambda c: grouped(F.col(c), F.col("style"))
    rows = [
        foot(0, CATEGORY["subtotal_amount"], F.when(r % 4 == 0, F.array(F.lit("Sub"), F.lit("Total"))).otherwise(F.array(F.lit("Subtotal:"))), F.array(text("subtotal"))),
        foot(1, CATEGORY["tax_amount"], F.array(F.lit("Tax")), F.when(r % 7 == 0, F.array(F.lit("10%"))).otherwise(F.array(text("tax")))),
        foot(2, CATEGORY["total_amount"], F.array(F.lit("TOTAL")), F.when(r % 2 == 0, F.array(F.lit("Rp"), text("total"))).otherwise(F.array(text("total")))),
    ]
    again = foot(3, CATEGORY["total_amount"], F.array(F.lit("Total")), F.array(grouped(F.col("total") + r % 2, F.col("style"))))
    feet = F.when(r % 5 == 0, F.array(*rows, again)).otherwise(F.array(*rows))
    return receipt_documents(spark, sf_dir).withColumn("lines", F.concat(F.transform("items", item), feet)).drop("items")


def receipt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: one row per line: receipt, line, category, group_id, words, n_key."""
    # the outer form, here and where rows are made of computed arrays: any other computes the array twice, for a filter below
    return lined_receipts(spark, sf_dir).select("receipt", F.inline_outer("lines"))


def shown_lines() -> Column:
    """The lines of a row of lined_receipts() as they are printed: array of struct(line, words), in order; words of struct(pos, text), in that order.

    Lines of one number are one line: the feet meet the items 100 to 103 of a receipt that has so many.
    """
    own = F.transform("lines", lambda x: F.struct(x["line"].alias("line"), F.transform(x["words"], lambda w, i: F.struct(i.alias("pos"), w.alias("text"))).alias("words")))

    def merged(x: Column) -> Column:
        rest = F.slice(x, F.lit(100), F.greatest(F.size(x), F.lit(1)))
        same = lambda k: F.sort_array(F.flatten(F.transform(F.filter(rest, lambda y: y["line"] == k), lambda y: y["words"])))
        numbers = F.sort_array(F.array_distinct(F.transform(F.filter(rest, lambda y: y["line"] < 104), lambda y: y["line"])))
        middle = F.transform(numbers, lambda k: F.struct(k.alias("line"), same(k).alias("words")))
        return F.concat(F.slice(x, 1, 99), middle, F.filter(rest, lambda y: y["line"] >= 104))

    return F.when(F.col("n_items") < 100, own).otherwise(let(own, merged))


def word_box(line: Column, pos: Column, text: Column) -> list[Column]:
    """The sides of a word's box, from integers only."""
    x0, y0 = pos * 120, line * 20
    return [c.cast("double") for c in (x0, y0, x0 + 10 * F.length(text), y0 + 16)]


def confidence(receipt: Column, line: Column, pos: Column) -> Column:
    return (50 + (receipt + 7 * line + 3 * pos) % 50).cast("double")


def receipt_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 over A4: receipt, line, pos, text, box, is_key, category, confidence. Boxes follow from integers only."""
    lines = receipt_lines(spark, sf_dir)
    flat = lines.select("receipt", "line", "category", "n_key", F.posexplode("words").alias("pos", "text"))
    return flat.select(
        "receipt", "line", "pos", "text", "category", (F.col("pos") < F.col("n_key")).alias("is_key"),
        F.array(*word_box(F.col("line"), F.col("pos"), F.col("text"))).alias("box"),
        confidence(F.col("receipt"), F.col("line"), F.col("pos")).alias("confidence"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: documents as pages of words: page_id, source, lang, text, words."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "source", "lang", "text", words(F.col("text")).alias("words"))


def reference(field: str) -> tuple[Column, Column]:
    """State and normalized_amount of a field from a row of receipts()."""
    state = {
        "subtotal_amount": F.lit("present_usable"),
        "tax_amount": F.when(F.col("receipt") % 7 == 0, "not_annotated").otherwise("present_usable"),
        "total_amount": F.when((F.col("receipt") % 5 == 0) & (F.col("receipt") % 2 == 1), "ambiguous_reference").otherwise("present_usable"),
    }
    return state[field], F.col(field.removesuffix("_amount")).cast("string")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each receipt's fields: receipt, field, state, normalized_amount. Derived from the integers, not from the lines' texts."""
    r = receipts(spark, sf_dir)
    cells = [F.struct(F.lit(f).alias("field"), state.alias("state"), known.alias("normalized_amount")) for f, (state, known) in ((f, reference(f)) for f in FIELDS)]
    return r.select("receipt", F.explode(F.array(*cells)).alias("c")).select("receipt", "c.*")


def answers() -> list[tuple[str, str, dict[str, Column]]]:
    """A6: three systems' answers from a row of receipts(): (system_id, field, columns raw_text, parse_status, normalized_amount, span_score).

    exact: the right digits; noisy: a digit too many on every sixth receipt, and no candidate on every eleventh;
    lazy: always the subtotal. Scores are fixed functions of the receipt.
    """
    cells = []
    for k, system in enumerate(("exact", "noisy", "lazy")):
        for f in FIELDS:
            right = F.col(f.removesuffix("_amount"))
            value = right if system == "exact" else F.col("subtotal") if system == "lazy" else F.when(F.col("receipt") % 6 == 0, right * 10 + 1).otherwise(right)
            missing = (F.col("receipt") % 11 == 0) if system == "noisy" else F.lit(False)
            cells.append((system, f, {
                "raw_text": F.when(~missing, grouped(value, F.col("style"))),
                "parse_status": F.when(missing, "no_candidate").otherwise("ok"),
                "normalized_amount": F.when(~missing, value.cast("string")),
                "span_score": F.when(~missing & (F.col("receipt") % 13 != 0), ((F.col("receipt") * 37 + k * 11) % 100) / 100.0),
            }))
    return cells


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6: answers() as rows: system_id, receipt, field, raw_text, parse_status, normalized_amount, span_score."""
    cells = [F.struct(F.lit(system).alias("system_id"), F.lit(f).alias("field"), *[c.alias(n) for n, c in columns.items()]) for system, f, columns in answers()]
    out = receipts(spark, sf_dir).select("receipt", F.inline(F.array(*cells)))
    return out.select("system_id", "receipt", "field", "raw_text", "parse_status", "normalized_amount", "span_score")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9: each turn of a conversation with the next one: conv_id, turn, role, text, next_text (null at the end)."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").withColumn("next_text", F.lead("text").over(by))
