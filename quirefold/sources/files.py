"""Readers and writers of record files (SRC-*, SNK-*)."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.text import spreadsheet_safe

RECORD = (
    "id string, page_id string, question string, words array<string>, boxes array<array<double>>, image_size array<int>, "
    "answer_start int, answer_end int, answers array<string>, field string"
)
MANIFEST = "batch string, folder string, file string, bytes long, sha256 string"
TSV = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf double, text string"


def read_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """SRC-01: one column of a Parquet source; only its chunks are read."""
    return spark.read.parquet(path).select(column)


def rows_at(spark: SparkSession, path: str, asked: DataFrame, columns: list[str], pattern: str | None = None) -> DataFrame:
    """SRC-01, SRC-08: the rows at physical places of a Parquet source: file, row, found, columns.

    asked has file (a name in the source) and row (from 0 within the file); every place asked for comes back once, found
    is false and the columns are null where a file has no such row. Places are what Spark's Parquet reader counts while it
    reads, so there is no rank and no sort; only the chunks of ``columns`` are read, and with ``pattern`` only the files
    whose names match it. A place that is asked for twice is answered once; nulls are never found.
    """
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    source = reader.parquet(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), F.lit(True).alias("_there"), *columns)
    wanted = asked.select("file", F.col("row").cast("long").alias("row")).distinct()
    size = wanted.agg(F.count("*"), F.min("row"), F.max("row")).first()
    if size[0]:  # rows outside the places asked for are left before the join
        source = source.where(F.col("row").between(size[1] or 0, size[2] or 0))
    wanted = F.broadcast(wanted) if size[0] * 64 <= 32 << 20 else wanted
    found = source.join(wanted, ["file", "row"], "left_semi")
    return wanted.join(found, ["file", "row"], "left").select("file", "row", F.coalesce("_there", F.lit(False)).alias("found"), *columns)


def read_jsonl(spark: SparkSession, path: str, schema: str = RECORD) -> tuple[DataFrame, DataFrame]:
    """SRC-09, SRC-11: (records, refused lines). Blank lines are skipped; a line that is no JSON object of the schema is refused, with its file."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value").where(F.trim("value") != "")
    return parse_lines(lines, schema)


def _running(pieces: DataFrame, value: Column, out: str) -> DataFrame:
    """Add the sum of value over the pieces of a file before each one. A block is summed up within itself; only its sum meets those of the file's other blocks."""
    own = pieces.withColumn("_v", value.cast("long"))
    sums = own.groupBy("file", "block").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("file", "block", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_from"))
    within = F.sum("_v").over(Window.partitionBy("file", "block").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    return own.withColumn("_w", F.coalesce(within, F.lit(0))).join(sums, ["file", "block"]).withColumn(out, F.col("_from") + F.col("_w")).drop("_v", "_w", "_from")


def array_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-09: (file, item, value) of files that hold one JSON array each, and (file, value) of those that do not, with the head of their text.

    Spark's text reader cuts a file at commas, each block by itself. Whether a comma is within a string, and how deep in
    brackets, follows from all pieces before: quotes are counted modulo two, then brackets outside strings, as running
    sums over pieces and blocks. Pieces between commas of the array itself are put together again, so a task holds one
    value or the pieces of one block, never a file. Strings within values are not interpreted otherwise.
    """
    raw = spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("piece"), "value")
    bare = F.regexp_replace("value", r"\\.", "")  # without escaped characters; a piece cannot begin with one, as a comma is none
    pieces = _running(raw.withColumn("segments", F.split(bare, '"', -1)), F.size("segments") - 1, "quotes")
    outside = F.filter("segments", lambda _, i: (F.col("quotes") + i) % 2 == 0)
    count = lambda c: F.length("outer") - F.length(F.translate("outer", c, ""))
    pieces = pieces.withColumn("outer", F.array_join(outside, " ")).withColumn("open", (F.col("quotes") + F.size("segments") - 1) % 2 == 1)
    pieces = _running(pieces.withColumn("delta", count("[{") - count("]}")).drop("segments"), F.col("delta"), "depth")
    after = F.col("depth") + F.col("delta")
    pieces = _running(pieces.withColumn("cut", ~F.col("open") & (after == 1)).withColumn("shut", ~F.col("open") & (after <= 0)).withColumn("below", after < 0), F.col("cut").cast("int"), "item")
    items = pieces.groupBy("file", "item").agg(F.array_sort(F.collect_list(F.struct("block", "piece", "value"))).alias("p"), F.max(F.col("shut").cast("int")).alias("shut"), F.count_if("shut").alias("shuts"), F.count_if("below").alias("below"))
    items = items.select("file", "item", F.array_join(F.transform("p", lambda x: x["value"]), ",").alias("value"), "shut", "shuts", "below")
    first, blank = F.col("item") == 0, r"[ \t\n\r]*"
    starts, ends = F.col("value").rlike(rf"^\x{{FEFF}}?{blank}\["), F.col("value").rlike(rf"\]{blank}$")
    inner = F.when(first, F.regexp_replace("value", rf"^\x{{FEFF}}?{blank}\[", "")).otherwise(F.col("value"))
    inner = F.when(F.col("shut") == 1, F.regexp_replace(inner, rf"\]{blank}$", "")).otherwise(inner)
    items = items.withColumn("inner", inner)
    lacks = F.col("inner").rlike(rf"^{blank}$")
    facts = items.groupBy("file").agg(
        F.count("*").alias("n"), F.sum("shuts").alias("shuts"), F.sum("below").alias("below"), F.max(F.when(F.col("shut") == 1, F.col("item"))).alias("last"), F.max("item").alias("most"),
        F.max((first & starts).cast("int")).alias("starts"), F.max(((F.col("shut") == 1) & ends).cast("int")).alias("ends"), F.count_if(lacks).alias("blank"), F.max(F.when(first, F.left("value", F.lit(200)))).alias("head"),
    )
    whole = (F.col("starts") == 1) & (F.col("ends") == 1) & (F.col("shuts") == 1) & (F.col("below") == 0) & (F.col("last") == F.col("most")) & ((F.col("blank") == 0) | (F.col("n") == 1))
    facts = facts.select("file", "head", F.coalesce(whole, F.lit(False)).alias("whole"))
    good = items.where(~lacks).join(facts.where("whole"), "file", "left_semi").select("file", "item", F.trim("inner").alias("value"))
    return good, facts.where(~F.col("whole")).select("file", F.col("head").alias("value"))


def read_dataset(spark: SparkSession, path: str, schema: str = RECORD) -> tuple[DataFrame, DataFrame]:
    """SRC-09: (records, refused values) of a .jsonl file of objects or a .json file that holds one array of them.

    Another suffix is an error. An array is split in parallel (see array_items); its values are then judged one by one as
    lines are. A .json file that holds no array is refused as one value, the head of its text.
    """
    if path.endswith(".jsonl"):
        return read_jsonl(spark, path, schema)
    if not path.endswith(".json"):
        raise ValueError(f"not .json or .jsonl: {path}")
    values, others = array_items(spark, path)
    good, bad = parse_lines(values.select("file", "value"), schema)
    return good, bad.unionByName(others.select("file", "value"))


def tsv_header(line: Column) -> Column:
    """SRC-12: whether a header line names the twelve columns of TSV, in this order."""
    return F.coalesce(line == "\t".join(T.StructType.fromDDL(TSV).names), F.lit(False))


def parse_lines(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """The same for a DataFrame with a column value; other columns are kept."""
    typed = T.StructType.fromDDL(f"{schema}, _bad string")
    parsed = lines.withColumn("r", F.from_json("value", typed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "allowNonNumericNumbers": "false"}))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull() | ~F.ltrim("value").startswith("{")
    names = [c for c in typed.names if c != "_bad"]
    good = parsed.where(~bad).select(*[c for c in lines.columns if c != "value"], *[F.col(f"r.`{c}`") for c in names])
    return good, parsed.where(bad).drop("r")


def json_kind(text: Column) -> Column:
    """JSN-02: what a JSON text is: OBJECT, ARRAY, STRING, a number's type ..., null if it is no JSON."""
    return F.regexp_extract(F.schema_of_variant(F.try_parse_json(text)), r"^[A-Z_]+", 0)


def parse_tsv(lines: DataFrame, key: str, width: Column, height: Column) -> DataFrame:
    """SRC-12: OCR rows (key, value: a line of 12 tab-separated columns) to words: key, text, box, line, confidence, reason.

    Only level 5 counts. Boxes are clipped to the page; blank texts and boxes without area get a reason instead of being
    lost; a negative confidence becomes null; tabs in the text stay in it.
    """
    c = F.split("value", "\t", 12)
    num = lambda i: F.get(c, F.lit(i)).try_cast("double")
    left, top = num(6), num(7)
    x0, y0 = F.greatest(F.lit(0.0), left), F.greatest(F.lit(0.0), top)
    x1, y1 = F.least(width.cast("double"), left + num(8)), F.least(height.cast("double"), top + num(9))
    text = F.trim(F.coalesce(F.get(c, F.lit(11)), F.lit("")))
    reason = F.when(F.size(c) < 12, "column_count").when(text == "", "blank").when((x1 <= x0) | (y1 <= y0), "no_area")
    rows = lines.where((F.size(c) < 12) | (num(0) == 5))
    return rows.select(
        key, text.alias("text"), F.array(x0, y0, x1, y1).alias("box"), F.array(*[num(i).cast("int") for i in (2, 3, 4)]).alias("line"),
        F.when(num(10) >= 0, num(10)).alias("confidence"), reason.alias("reason"),
    )


def strict_json(path: str) -> object:
    """SRC-10: a small settings file; repeated keys and numbers that are not finite are refused. For the driver."""

    def unique(pairs):
        keys = [k for k, _ in pairs]
        if len(set(keys)) < len(keys):
            raise ValueError(f"{path}: repeated key")
        return dict(pairs)

    def refuse(name):
        raise ValueError(f"{path}: {name}")

    with open(path, encoding="utf-8") as f:
        return json.load(f, object_pairs_hook=unique, parse_constant=refuse)


def write_records(df: DataFrame, path: str, **limits: int) -> None:
    """SNK-01: JSON lines in the fixed order of keys; null keys are left out. limits: options of the writer, as maxRecordsPerFile."""
    order = [c for c in T.StructType.fromDDL(RECORD).names if c in df.columns]
    df.select(*order, *[c for c in df.columns if c not in order]).write.option("ignoreNullFields", "true").options(**limits).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """SNK-03: CSV that a spreadsheet cannot run: strings made safe, nested values as JSON."""
    cols = []
    for f in df.schema:
        value = F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{f.name}`")
        cols.append((spreadsheet_safe(value) if isinstance(f.dataType, T.StringType) else value).alias(f.name))
    df.select(*cols).write.option("header", "true").option("escape", '"').csv(path)


def append_log(df: DataFrame, path: str) -> None:
    """SNK-09, SRC-25: append-only log."""
    df.write.mode("append").json(path)


# What references may be read for.
PURPOSES = (
    "training_supervision", "keyword_development", "model_selection", "policy_selection", "final_evaluation",
    "reference_text_diagnostic", "recoverability_diagnostic", "source_audit", "byod_training_supervision",
)


def _committed(spark: SparkSession, path: str) -> DataFrame | None:
    """The manifest of an export set, or None before its first commit."""
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def shared_folder(spark: SparkSession) -> str:
    """A folder of the application below spark.checkpoint.dir, which driver and executors share; on a local master without that setting, a new one of this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{at.rstrip('/')}/{spark.sparkContext.applicationId}" if at else tempfile.mkdtemp(prefix="spark-")


#: Rows of a file of an export, fewer if these have more bytes: whoever digests a file holds all of it.
FILE_ROWS, FILE_BYTES = 100_000, 32 << 20


def export_batch(df: DataFrame, path: str, batch: str, file_rows: int = FILE_ROWS, file_bytes: int = FILE_BYTES) -> bool:
    """SNK-01, SNK-04: add df to the export set at path as JSON lines, with a manifest of digests as commit record.

    The files of a batch go to a folder of their own; then one line for each, with bytes and SHA-256, is appended to the
    manifest in one write. Readers go by the manifest, so what an aborted job leaves is never read. A batch is taken
    once: if the manifest has it, nothing is written and False is returned. Batches of one set must come one at a time.
    A file has at most ``file_rows`` rows; if one has more than ``file_bytes`` bytes, all are written again with fewer.
    """
    spark = df.sparkSession
    if not re.fullmatch(r"[A-Za-z0-9_.:-]{1,64}", batch):
        raise ValueError(f"not a batch name: {batch!r}")
    known = _committed(spark, path)
    if known is not None and not known.where(F.col("batch") == batch).isEmpty():
        return False
    folder = f"data/{batch.replace(':', '_')}-{uuid.uuid4().hex}"
    write_records(df, f"{path}/{folder}", maxRecordsPerFile=file_rows)
    written = lambda: spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(f"{path}/{folder}")
    while (largest := written().agg(F.max("length")).first()[0] or 0) > file_bytes and file_rows > 1:  # contents are not read for it
        large, folder = f"{path}/{folder}", f"data/{batch.replace(':', '_')}-{uuid.uuid4().hex}"
        file_rows = max(1, min(file_rows // 2, file_rows * file_bytes // largest))
        write_records(spark.read.schema(df.schema).json(large), f"{path}/{folder}", maxRecordsPerFile=file_rows)
        at = spark._jvm.org.apache.hadoop.fs.Path(large)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    files = written()
    listed = files.select(F.lit(batch).alias("batch"), F.lit(folder).alias("folder"), F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    listed.coalesce(1).write.mode("append").json(f"{path}/manifest")  # a line a file
    return True


def read_export(spark: SparkSession, path: str, schema: T.StructType | str, purpose: str, roles: list[str] | None = None) -> DataFrame:
    """SRC-25, SNK-09: the committed rows of an export set, of some roles only if given, with a line in its log of reads: purpose, roles, count.

    An undeclared purpose is refused before anything is read, files that no longer have the bytes and digest of the
    manifest are too. Uncommitted files are not seen; a set without a commit has no rows.
    """
    if purpose not in PURPOSES:
        raise ValueError(f"undeclared purpose: {purpose!r}")
    manifest = _committed(spark, path)
    folders = [] if manifest is None else sorted(r.folder for r in manifest.select("folder").distinct().collect())  # one row a batch
    rows = spark.createDataFrame([], schema)
    if folders:
        places = [f"{path}/{f}" for f in folders]
        have = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(places)
        last = lambda c, i: F.element_at(F.split(c, "/"), i)
        named = have.withColumn("path", F.concat_ws("/", last("path", -2), last("path", -1)))
        listed = manifest.select(F.concat_ws("/", last("folder", -1), "file").alias("path"), "bytes", "sha256")
        if wrong := verify_digests(named, listed).head():
            raise ValueError(f"{wrong.path}: {wrong.problem}")
        rows = spark.read.schema(schema).json(places)
    if roles is not None:
        rows = rows.where(F.col("role").isin(roles))
    append_log(spark.createDataFrame([(purpose, roles, rows.count())], "purpose string, roles array<string>, count long"), f"{path}/reads")
    return rows


def verify_digests(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """SRC-03, SRC-17, VAL-15: files (path, content) against a manifest (path, bytes, sha256): path, problem of every difference."""
    have = files.select("path", F.length("content").cast("long").alias("_n"), F.sha2("content", 256).alias("_sha"))
    both = have.join(manifest.select("path", "bytes", "sha256"), "path", "full_outer")
    problem = F.when(F.col("_n").isNull(), "missing").when(F.col("bytes").isNull(), "undeclared").when(F.col("_n") != F.col("bytes"), "size").when(F.col("_sha") != F.col("sha256"), "digest")
    return both.select("path", problem.alias("problem")).where("problem is not null")


def quoted_digests(rows: DataFrame, key: str, text: str, digits: int) -> DataFrame:
    """SRC-24: hex digests of a length that a text quotes: key, digest. Join left-anti with known digests to find strays and stale entries."""
    found = F.regexp_extract_all(F.col(text), F.lit(rf"(?<![0-9a-f])([0-9a-f]{{{digits}}})(?![0-9a-f])"), 1)
    return rows.select(key, F.explode(F.array_distinct(found)).alias("digest"))
