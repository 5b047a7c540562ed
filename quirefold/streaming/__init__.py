"""Structured Streaming intake of page records; all its expressions are stateless but the removal of repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_answer, words

PAGE = "page_id string, text string, at timestamp"


def stream_pages(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """JSON lines that arrive in a folder, as pages."""
    return spark.readStream.schema(PAGE).option("maxFilesPerTrigger", max_files).json(path)


def intake(pages: DataFrame, late: str = "1 hour") -> DataFrame:
    """Pages with their words; a page whose normalised text came before, within the watermark, is dropped."""
    keyed = pages.withWatermark("at", late).withColumn("content", F.sha2(normalize_answer(F.col("text")), 256))
    return keyed.dropDuplicatesWithinWatermark(["content"]).withColumn("words", words(F.col("text")))
