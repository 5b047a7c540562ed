"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of letters, digits and all code points from 0x80; A-Z is lower-cased before.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Folders of local sessions that name none, by application.
_own_dirs: dict[str, str] = {}


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else unchanged. lower() does that alone where the text is ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The lower-cased words of a text as an array; null has none."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), WORD_GAP), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local master, whose executors run on this machine, may do without: it gets one new folder per session. On a
    cluster a missing setting is an error, as files in a machine's own folder would be lost to the others.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="spark-")
        at = _own_dirs[app]
    return at.rstrip("/")


#: While a table is written: shuffle files go when it is finished, and Arrow batches are small, as texts are long and an
#: executor's Python workers share little memory.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Hold session settings, then set them back to what they were."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def new_path(spark: SparkSession, name: str) -> str:
    """A path for a new table. All tables of an application are in one folder below the shared one, to be removed together when it has ended."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write df to path, in a folder for each value of ``by``, and read it back."""
    with settings(df.sparkSession, WRITING):
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, name: str = "step", by: tuple[str, ...] = ()) -> DataFrame:
    """Write df to the shared folder and read it back: later jobs start from these files, which outlive any executor."""
    return write_table(df, new_path(df.sparkSession, name), by)


def remove_table(spark: SparkSession, path: str) -> None:
    """Remove a table of write_table() that nothing reads any more, as iterations would fill the shared folder else."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def in_arrow(df: DataFrame, function, schema: StructType | str) -> DataFrame:
    """df.mapInArrow(). Functions handle any size of batch; cut() keeps batches small."""
    return df.mapInArrow(function, schema)


def named(name: str) -> Column:
    """The column of exactly this name, which may hold dots, spaces and back quotes."""
    return F.col(f"`{name.replace('`', '``')}`")


def extended(df: DataFrame, keep: list[str], ddl: str) -> StructType:
    """The schema of df's columns keep, of any name and type, followed by those of a DDL string."""
    return StructType([*(df.schema[c] for c in keep), *StructType.fromDDL(ddl).fields])


def ranked(df: DataFrame, cls: str, order: list[str], total: int | None = None) -> DataFrame:
    """Add ``class_rank`` (from 0 within cls) and ``rank`` (from 0 over all rows, by cls and then order-hash buckets).

    A class, which may hold most rows, is split into hash buckets of about sqrt(rows) rows; only the bucket counts,
    at most classes + sqrt(rows) of them, meet in one task or are broadcast. df must be cheap to read again (see cut)
    and cls must have a bounded number of values. ``order`` should tell all rows apart: rows equal in it are
    interchangeable. Rows of a class are ordered by (bucket, order), which is the same in every run.
    """
    total = df.count() if total is None else total
    per = max(1, int(total**0.5))
    sizes = df.groupBy(cls).agg(F.count("*").alias("_n"))
    dealt = (
        df.join(F.broadcast(sizes), df[cls].eqNullSafe(sizes[cls]))
        .drop(sizes[cls])
        .withColumn("_bucket", F.pmod(F.xxhash64(*order), F.ceil(F.col("_n") / per)))
        .drop("_n")
    )
    by = Window.orderBy(cls, "_bucket")
    marks = (
        dealt.groupBy(cls, "_bucket")
        .agg(F.count("*").alias("_k"))
        .withColumn("_from", F.sum("_k").over(by.rowsBetween(Window.unboundedPreceding, -1)))
        .select(cls, "_bucket", F.coalesce("_from", F.lit(0)).alias("_from"))
        .withColumn("_class_from", F.min("_from").over(Window.partitionBy(cls)))
    )
    within = F.row_number().over(Window.partitionBy(cls, "_bucket").orderBy(*order)) - 1
    out = dealt.withColumn("_row", within)
    on = out[cls].eqNullSafe(marks[cls]) & (out["_bucket"] == marks["_bucket"])
    return (
        out.join(F.broadcast(marks), on)
        .drop(marks[cls])
        .drop(marks["_bucket"])
        .withColumn("rank", F.col("_from") + F.col("_row"))
        .withColumn("class_rank", F.col("rank") - F.col("_class_from"))
        .drop("_bucket", "_from", "_class_from", "_row")
    )


def broadcast_if_small(df: DataFrame, row_bytes: int, most: int = 32 << 20) -> DataFrame:
    """df with a broadcast hint if its rows take at most ``most`` bytes; else as it is, to be joined by a shuffle. df must be cheap to count."""
    return F.broadcast(df) if df.count() * row_bytes <= most else df
