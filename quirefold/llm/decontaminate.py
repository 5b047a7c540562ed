"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

A window of an item can only occur where its rarest shingle does. So each window is joined by that one shingle (its
necessary prefix under the order of rarity in the corpus), the place of the shingle gives the only possible start of the
window (positional bound), the window must end inside the document (length bound), and the words are then compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import broadcast_if_small, cut, words

WINDOW, SHINGLE = 13, 3
#: Estimated bytes up to which a side made from the benchmark is broadcast; beyond, the join is shuffled.
BROADCAST_BYTES = 32 << 20
IS_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per item text: item (id as text), words, span (words of a window). Items without words are left out."""
    flat = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words(F.col("text")).alias("words"))
    return flat.where(F.size("words") > 0).distinct().withColumn("span", F.least(F.lit(window), F.size("words")))


def shingle(array: str, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(F.col(array), at + i) for i in range(size)])


def _tokens(rows: DataFrame, size: int, *keep: str) -> DataFrame:
    """A row for each place in the array column words: keep, pos, token (hash of the shingle that starts there).

    The outer form keeps Spark from adding a filter that would split every text a second time; a text without words
    gives one row with a null place.
    """
    return rows.select(*keep, "words", F.posexplode_outer("words").alias("pos", "_w")).select(*keep, "words", "pos", shingle("words", F.col("pos"), size).alias("token"))


def _small(df: DataFrame, size: Column) -> bool:
    return (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def anchors(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """The places in the items that are joined: token, item, words, span, anchor (place), starts (windows that it stands for).

    For each window the shingle with the fewest occurrences in docs is taken. A window with a shingle that never occurs
    cannot occur itself and falls away.
    """
    places = cut(_tokens(items, size, "item", "span").where(F.col("pos") <= F.size("words") - size), "places")
    known = places.select("token").distinct()
    known = F.broadcast(known) if _small(places, F.lit(64)) else known
    counts = _tokens(docs, size).select("token").join(known, "token").groupBy("token").agg(F.count("*").alias("n"))
    starts = F.sequence(F.greatest(F.lit(0), F.col("pos") + size - F.col("span")), F.least(F.col("pos"), F.size("words") - F.col("span")))
    choice = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "pos")
    chosen = (
        places.join(counts, "token", "left")
        .select("item", "words", "span", choice.alias("choice"), F.explode(starts).alias("start"))
        .groupBy("item", "words", "span", "start")
        .agg(F.min("choice").alias("choice"))
        .where("choice.n > 0")
    )
    return chosen.groupBy("item", "words", "span", F.col("choice.token").alias("token"), F.col("choice.pos").alias("anchor")).agg(F.collect_list("start").alias("starts"))


def occurrences(docs: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of words that windows of items cover: keys, item, start, stop. docs: keys and words."""
    found = None
    sizes = sorted(r[0] for r in items.select(F.least(F.lit(SHINGLE), "span")).distinct().collect())  # 1, 2, 3 at most
    for size in sizes:
        own = items.where(F.least(F.lit(SHINGLE), "span") == size)
        marks = cut(anchors(docs, own, size), "anchors").withColumnRenamed("words", "item_words")
        places = _tokens(docs, size, *keys)
        if _small(marks, F.size("item_words") * 24 + F.size("starts") * 8 + 128):
            met = places.join(F.broadcast(marks), "token")
        else:
            by = ["token", "item", "anchor", "item_words"]
            met = places.drop("words").join(marks.select("token", "item", "anchor"), "token").join(marks.withColumnRenamed("token", "_t"), ["item", "anchor"])
            met = met.where("token = _t").drop("_t").join(docs, keys).select(*keys, "words", "pos", *by, "span", "starts")
        moved = F.col("pos") - F.col("anchor")
        fits = F.filter(
            "starts",
            lambda s: (moved + s >= 0)
            & (moved + s + F.col("span") <= F.size("words"))
            & (F.slice("words", F.greatest(moved + s, F.lit(0)) + 1, F.col("span")) == F.slice("item_words", s + 1, F.col("span"))),
        )
        # All windows of one anchor hold its place, so what they cover is one run. Comparing the words must not become a
        # condition of the join: that would leave generated code and copy a text's words for each of its places.
        run = F.struct((moved + F.array_min(fits)).alias("start"), (moved + F.array_max(fits) + F.col("span")).alias("stop"))
        hits = met.select(*keys, "item", F.explode_outer(F.array(run)).alias("run")).select(*keys, "item", "run.*").where("start is not null")
        found = hits if found is None else found.unionByName(hits)
    return found


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and share * n_hit >= n_words), text_hash.

    Words: runs of letters, digits and code points from 0x80, A-Z lower-cased. Null or empty texts have no words and no
    hits. Items without words are skipped; an item with fewer words than the window is one window; a null item_id counts
    as 'null'. Documents are told apart by doc_id and a hash of the text, so rows that share a doc_id are judged by
    their own text and repeated rows get equal results. Without items or documents the result has no hits, or no rows.
    """
    keys = ["doc", "text_hash"]
    doc = F.struct("doc_id").alias("doc")  # a struct is never null itself
    docs = documents.select(doc, F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words"))
    base = documents.select("doc_id", doc, F.xxhash64("text").alias("text_hash"), F.coalesce(F.regexp_count("text", F.lit(IS_WORD)), F.lit(0)).cast("long").alias("n_words"))
    items = cut(item_windows(benchmark, window), "items")
    hits = occurrences(docs, items, keys)
    empty = F.sha2(F.lit(""), 256)
    if hits is None:
        return base.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), empty.alias("items_sha256"), F.lit(False).alias("contaminated"), "text_hash")
    by_start = Window.partitionBy(*keys).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(F.max("stop").over(by_start), F.lit(0))))
    found = hits.withColumn("fresh", fresh).groupBy(*keys).agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return base.join(found, keys, "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.sha2(F.array_join("items", ","), 256), empty).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
        "text_hash",
    )


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, in their own columns, that are not contaminated."""
    bad = cut(contamination(documents, benchmark).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), "bad")
    same = documents["doc_id"].eqNullSafe(bad["_id"]) & (F.xxhash64(documents["text"]) == bad["_hash"])
    return documents.join(broadcast_if_small(bad, 24), same, "left_anti")
