"""Annotations to pages, pages to questions, and splits by page (PRJ-*, SEL-*, WIN-*, SPL-*)."""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.binding import let
from ..functions.geometry import clip
from ..functions.text import collapse
from .ordering import hash_rank, hash_running_total

# The question of each line category, in template order.
TEMPLATES = {
    "total.total_price": "What is the total amount?",
    "sub_total.subtotal_price": "What is the subtotal?",
    "sub_total.tax_price": "What is the tax amount?",
    "sub_total.service_price": "What is the service charge?",
    "sub_total.discount_price": "What is the discount amount?",
    "total.cashprice": "How much cash was paid?",
    "total.changeprice": "How much change was given?",
    "total.creditcardprice": "How much was paid by card?",
    "total.menuqty_cnt": "How many items were bought?",
    "menu.nm": "What is the name of the first item?",
}
FIRST_ITEM = "menu.nm"
ANNOTATION = (
    "gt_parse variant, meta struct<image_size: struct<width: int, height: int>>, valid_line array<struct<category: string, group_id: int, "
    "words: array<struct<quad: map<string, double>, is_key: int, text: string>>>>"
)


def annotation(text: Column) -> Column:
    """JSN-01: a JSON annotation as a struct, parsed once however many of its parts are used."""
    return let(F.from_json(text, ANNOTATION), lambda d: d)


def annotation_words(text: Column) -> Column:
    """JSN-01, PRJ-01: a JSON annotation as an array of struct(line, category, group_id, pos (in the page), text, box, is_key).

    Words with an empty text or a box without area on the page are dropped; positions count what is left, from 0.
    """
    return let(F.from_json(text, ANNOTATION), read_words)


def read_words(d: Column) -> Column:
    """annotation_words() of an annotation that is a struct already."""
    size = d["meta"]["image_size"]

    def word(line: Column, at: Column, w: Column) -> Column:
        side = {a: F.array(*[w["quad"][f"{a}{i}"] for i in range(1, 5)]) for a in "xy"}
        box = clip(side["x"], side["y"], size["width"], size["height"])
        return F.struct(at.alias("line"), line["category"].alias("category"), line["group_id"].alias("group_id"), collapse(w["text"]).alias("text"), box.alias("box"), (w["is_key"] == 1).alias("is_key"))

    said = F.flatten(F.transform(d["valid_line"], lambda line, at: F.transform(line["words"], lambda w: word(line, at, w))))
    kept = F.filter(said, lambda x: (x["text"] != "") & x["box"].isNotNull())
    return F.transform(kept, lambda x, i: F.struct(x["line"].alias("line"), x["category"].alias("category"), x["group_id"].alias("group_id"), i.alias("pos"), x["text"].alias("text"), x["box"].alias("box"), x["is_key"].alias("is_key")))


def parse_annotations(rows: DataFrame, key: str, text: str) -> DataFrame:
    """annotation_words() as rows: key, line, category, group_id, pos, text, box, is_key. The outer form is parsed once."""
    return rows.select(key, F.inline_outer(annotation_words(F.col(text)))).where("pos is not null")


def line_spans(words: Column) -> Column:
    """Lines as struct(line, category, group_id, start, end, top, value_start, value_end, answer) from annotation_words().

    The span of the value words is null unless these are one contiguous run (ARR-02).
    """

    def span(own: Column) -> Column:
        value = F.filter(own, lambda w: ~w["is_key"])
        first, last, start, end = F.get(own, F.lit(0)), F.try_element_at(own, F.lit(-1)), F.get(value, F.lit(0))["pos"], F.try_element_at(value, F.lit(-1))["pos"]
        run = (F.size(value) > 0) & (end - start + 1 == F.size(value))
        answer = F.array_join(F.transform(value, lambda w: w["text"]), " ")
        return F.struct(
            first["line"].alias("line"), first["category"].alias("category"), first["group_id"].alias("group_id"), first["pos"].alias("start"), last["pos"].alias("end"), first["box"][1].alias("top"),
            F.when(run, start).alias("value_start"), F.when(run, end).alias("value_end"), F.when(run, answer).alias("answer"),
        )

    return F.transform(F.array_distinct(F.transform(words, lambda w: w["line"])), lambda k: let(F.filter(words, lambda w: w["line"] == k), span))


def questions(lines: Column) -> Column:
    """PRJ-02, SEL-01, SEL-02: struct(field, question, template, answer_start, answer_end, answer) of the lines of one page.

    One question per category that is on exactly one line; for the first item the topmost line, unless its group has
    more lines. Lines without a contiguous run of value words give none.
    """
    known = F.create_map(*[F.lit(x) for kv in TEMPLATES.items() for x in kv])
    order = F.create_map(*[F.lit(x) for i, c in enumerate(TEMPLATES) for x in (c, i)])

    def asked(own: Column) -> Column:
        first = F.array_min(F.transform(own, lambda x: F.struct(*[x[c].alias(c) for c in ("top", "start", "group_id", "value_start", "value_end", "answer", "category")])))
        return let(first, lambda f: F.when(single(own, f) & f["value_start"].isNotNull(), row(f)))

    def single(own: Column, f: Column) -> Column:
        same = F.filter(own, lambda x: x["group_id"].eqNullSafe(f["group_id"]))
        return F.when(f["category"] == FIRST_ITEM, F.size(same) == 1).otherwise(F.size(own) == 1)

    def row(f: Column) -> Column:
        c = f["category"]
        return F.struct(
            c.alias("field"), F.element_at(known, c).alias("question"), F.element_at(order, c).alias("template"),
            f["value_start"].alias("answer_start"), f["value_end"].alias("answer_end"), f["answer"].alias("answer"),
        )

    def each(kept: Column) -> Column:
        categories = F.array_distinct(F.transform(kept, lambda x: x["category"]))
        found = F.transform(categories, lambda c: let(F.filter(kept, lambda x: x["category"] == c), asked))
        return F.filter(found, lambda q: q.isNotNull())

    return let(F.filter(lines, lambda x: x["category"].isin(*TEMPLATES)), each)


def page_questions(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, field, question, template, answer_start, answer_end, answer of JSON annotations, each within its row."""
    found = let(annotation_words(F.col(text)), lambda w: let(line_spans(w), questions))
    return rows.select(key, F.inline_outer(found)).where("field is not null")


def first_pages(pages: DataFrame, content: Column, order: str) -> DataFrame:
    """WIN-02: of pages with equal content the first in order stays. Content is summed as digest before the shuffle."""
    keyed = pages.withColumn("_content", F.sha2(content, 256))
    kept = keyed.groupBy("_content").agg(F.min(order).alias(order)).select(order)
    return pages.join(kept, order, "left_semi")


def duplicate_families(rows: DataFrame, key: str, content: Column, role: Column) -> DataFrame:
    """WIN-04, AGG-18: key, family (digest), members, verdict of each row whose content occurs twice or more.

    If the family's roles differ all are quarantined; else the smallest key is kept and the others are excluded.
    """
    keyed = rows.select(key, F.sha2(content, 256).alias("family"), role.alias("_role"))
    sums = keyed.groupBy("family").agg(F.count("*").alias("members"), F.min(key).alias("_first"), (F.min("_role") != F.max("_role")).alias("_mixed")).where("members > 1")
    verdict = F.when(F.col("_mixed"), "quarantined").when(F.col(key) == F.col("_first"), "kept").otherwise("excluded")
    return keyed.join(sums, "family").select(key, "family", "members", verdict.alias("verdict"))


def half_split(rows: DataFrame, key: str, tag: str, names: tuple[str, str]) -> DataFrame:
    """WIN-03: the first half of the hash order gets the first name; key, role."""
    n = rows.count()
    ranked = hash_rank(rows.select(key, F.sha2(F.concat(F.lit(f"{tag}|"), F.col(key).cast("string")), 256).alias("h")), "h")
    return ranked.select(key, F.when(F.col("rank") < n // 2, names[0]).otherwise(names[1]).alias("role"))


def greedy_split(groups: DataFrame, key: str, size: str, n_test: int, n_validation: int, tag: str) -> DataFrame:
    """WIN-05: whole groups, in hash order, fill test, then validation, then train: key, size, split.

    A group goes to test if the records before it are fewer than n_test, to validation if those after test are fewer
    than n_validation. The order is fixed by a hash instead of a shuffled list, so it needs no driver.
    """
    hashed = groups.select(key, size, F.sha2(F.concat(F.lit(f"{tag}|"), F.col(key).cast("string")), 256).alias("h"))
    run = hash_running_total(hashed, "h", size)
    in_test = run.where(F.col("before") < n_test).agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    split = F.when(F.col("before") < n_test, "test").when(F.col("before") - in_test < n_validation, "validation").otherwise("train")
    return run.select(key, size, split.alias("split"))


def split_overlaps(rows: DataFrame, content: Column, split: str) -> DataFrame:
    """JON-18, SPL-03: contents that occur in more than one split: content (digest), splits."""
    found = rows.groupBy(F.sha2(content, 256).alias("content")).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    return found.where(F.size("splits") > 1).select("content", F.array_join("splits", ",").alias("splits"))


def seeded_order(spark, keys: list, seed: int) -> DataFrame:
    """SPL-01, SPL-02: key, position after Python's seeded shuffle of at most 20,000 page ids, in their given order.

    That shuffle is defined on a list, so the ids pass through the driver; more are refused. For larger sets use greedy_split.
    """
    if len(keys) > 20_000:
        raise ValueError("a seeded shuffle takes at most 20,000 pages")
    order = list(keys)
    random.Random(seed).shuffle(order)
    return spark.createDataFrame(list(enumerate(order)), "position long, key string" if keys and isinstance(keys[0], str) else "position long, key long")


#: Rounds of a permutation, and steps after which every place is back in range: outside it are fewer than the root of n.
ROUNDS, WALK = 6, 33


def permuted_place(rank: Column, n: int, seed: int) -> Column:
    """SPL-01, TOP-09: the place, from 0 to n - 1, of each rank from 0 to n - 1 in a shuffle by ``seed``; each row computes its own.

    A keyed Feistel network over a grid of a x b >= n cells: each round adds a hash of one coordinate to the other, which
    can be undone, so places are a permutation of the cells. A place beyond n goes through the network again until it is
    within (cycle walking), which makes it a permutation of the ranks.
    """
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    b = max(1, -(-n // a))

    def mixed(i: int, x: Column) -> Column:
        return F.conv(F.left(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(i)), x.cast("string"))), F.lit(12)), 16, 10).cast("long")

    def rounds(i: int, at: Column) -> Column:
        if i == ROUNDS:
            return at["r"] * a + at["l"]
        l, r = at["l"], at["r"]
        cell = F.struct(((l + mixed(i, r)) % a).alias("l"), r.alias("r")) if i % 2 == 0 else F.struct(l.alias("l"), ((r + mixed(i, l)) % b).alias("r"))
        return let(cell, lambda x: rounds(i + 1, x))

    def once(x: Column) -> Column:
        x = x.cast("long")
        return let(F.struct((x % a).alias("l"), F.floor(x / a).cast("long").alias("r")), lambda at: rounds(0, at))

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(rank), lambda x, _: F.when(x >= n, once(x)).otherwise(x))


def sample_splits(rows: DataFrame, key: str, content: Column, sizes: dict[str, int], seed: int = 42) -> DataFrame:
    """SPL-01, SRC-05: key, place, split: of the pages with different contents exactly ``sizes`` for each split, in a shuffled order.

    The first page of each content, by key, is taken; fewer pages than the sizes need are refused. Ranks come from a hash
    order and places from ranks, so nothing is sorted as a whole or held by the driver but the number of pages.
    """
    own = first_pages(rows.select(key, content.alias("_words")), F.col("_words"), key).select(key)
    ranked = hash_rank(own.withColumn("_h", F.sha2(F.concat(F.lit("rank|"), F.col(key).cast("string")), 256)), "_h")
    n, needed = own.count(), sum(sizes.values())
    if n < needed:
        raise ValueError(f"{n} pages, but the splits need {needed}")
    placed = ranked.select(key, permuted_place(F.col("rank"), n, seed).alias("place")).where(F.col("place") < needed)
    split, upto = None, 0
    for name, size in sizes.items():
        upto += size
        split = F.when(F.col("place") < upto, name) if split is None else split.when(F.col("place") < upto, name)
    return placed.withColumn("split", split)


# The records that each split needs at least.
MINIMUMS = {"train": 8, "validation": 2, "test": 2}


def split_shortfalls(rows: DataFrame, split: str, least: dict[str, int] | None = None) -> DataFrame:
    """SPL-02: split, n, least, missing of the splits with too few rows. A caller refuses the split unless this is empty."""
    least = MINIMUMS if least is None else least
    wanted = rows.sparkSession.range(1).select(F.explode(F.create_map(*[x for k, v in least.items() for x in (F.lit(k), F.lit(v).cast("long"))])).alias(split, "least"))
    counts = rows.groupBy(split).agg(F.count("*").alias("n"))
    out = wanted.join(counts, split, "left").select(split, F.coalesce("n", F.lit(0)).alias("n"), "least")
    return out.withColumn("missing", F.col("least") - F.col("n")).where("missing > 0")
