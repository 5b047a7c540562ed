"""OCR over a cohort of images: cached results, a pluggable engine, checks of image bytes (SRC-18 to 21, VAL-14, HSH-05)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 20 << 20


def image_problem(content: Column) -> Column:
    """VAL-14: why image bytes are refused: too large, or neither JPEG nor PNG. Null if they pass; decoding is the engine's work."""
    head = F.hex(F.substring(content, 1, 8))
    known = head.startswith("FFD8FF") | (head == "89504E470D0A1A0A")
    return F.when(content.isNull() | (F.length(content) == 0), "empty").when(F.length(content) > MOST_BYTES, "too_large").when(~known, "not_jpeg_or_png")


def cohort_ocr(cohort: DataFrame, cache: DataFrame, engine: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """SRC-20: cohort (receipt, key, ...) with cached results (key, status, tokens); misses go through the engine, once per key.

    engine takes a DataFrame with the column key and returns key, status, tokens: a join, a mapInPandas of a real OCR
    program, or a test double. A failure is a row with its status. The receipt is always the cohort's own.
    """
    missing = cohort.select("key").distinct().join(cache.select("key"), "key", "left_anti")
    fresh = engine(missing).select("key", "status", "tokens", F.lit(False).alias("cached"))
    known = cache.select("key", "status", "tokens", F.lit(True).alias("cached")).unionByName(fresh)
    return cohort.join(known, "key", "left").withColumn("status", F.coalesce("status", F.lit("ocr_error")))


def table_engine(table: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """SRC-19, SRC-21: a test double that looks results up by key; no row: ocr_error; no tokens: ocr_empty."""

    def run(keys: DataFrame) -> DataFrame:
        found = keys.join(table.select("key", "tokens"), "key", "left")
        status = F.when(F.col("tokens").isNull(), "ocr_error").when(F.size("tokens") == 0, "ocr_empty").otherwise("ok")
        return found.withColumn("status", status)

    return run
