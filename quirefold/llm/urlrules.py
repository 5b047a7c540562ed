"""URL rules by a sort-merge range join on reversed-host keys.

A host's labels are reversed and closed one by one with a mark, so that a host and all its subdomains form one interval
of keys. Pages and the bounds of the rules' intervals are sorted together, dealt by range, and swept: the latest bound
before a page carries the stack of the rules that are active there. All of it is DataFrame work.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, cut

#: Estimated bytes up to which the stacks at the ends of the parts are broadcast.
BROADCAST_BYTES = 32 << 20
MARK, PAST = "\x01", "\x02"


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or no ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def reversed_host(host: Column) -> Column:
    """a.example.net -> net|example|a| with MARK for the bars."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), MARK), F.lit(MARK))


def rules_table(spark: SparkSession, rules: Iterable[tuple[str, str]]) -> DataFrame:
    """(verdict, "host/path") pairs as a DataFrame: host, path, rule, verdict."""
    rows = [F.struct(*map(F.lit, (f"{(h := r.partition('/'))[0]}", f"/{h[2]}", r, v))) for v, r in rules]
    cols = F.inline(F.array(*rows)) if rows else F.inline(F.expr("cast(array() as array<struct<a:string,b:string,c:string,d:string>>)"))
    return spark.range(1).select(cols.alias("host", "path", "rule", "verdict"))


def rule_bounds(rules: DataFrame) -> DataFrame:
    """Where the stack of active rules changes: key and the stack from there on, longest rule first.

    The rules of one host stay together in one row: they are configuration of that host. Enclosing hosts are found by an
    equi-join on the host's own parents, one row for each label.
    """
    entry = F.struct((-F.length("rule")).alias("rank"), F.col("host"), F.col("path"), F.col("rule"), F.col("verdict"))
    own = rules.groupBy("host").agg(F.collect_set(entry).alias("own"))
    labels = F.split("host", r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    up = own.select(F.col("host").alias("inner"), F.explode(parents).alias("host"))
    stacks = (
        up.join(own, "host")
        .groupBy("inner")
        .agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("stack"))
        .withColumn("base", F.substring(reversed_host(F.col("inner")), F.lit(1), F.length(reversed_host(F.col("inner"))) - 1))
    )
    opened = stacks.select(F.concat("base", F.lit(MARK)).alias("key"), "stack")
    closed = stacks.select(F.concat("base", F.lit(PAST)).alias("key"), F.filter("stack", lambda r: r["host"] != F.col("inner")).alias("stack"))
    return opened.unionByName(closed)


def judge_urls(pages: DataFrame, rules: DataFrame, keep: list[str], default: str = "allow", parts: int | None = None) -> DataFrame:
    """Add host, path, rule (null if none fits) and verdict to the kept columns of pages, from its column url.

    A rule fits its host and all subdomains if the path starts with the rule's path. The longest rule text wins; among
    equals the smaller host. Without a fitting rule the verdict is ``default``. Null urls and urls without :// have an
    empty host and path. Repeated rows are judged one by one; no rules, or no pages, is fine. Rows are dealt by
    (key, path, hash), so that a hot host, or even a hot url, is spread over many tasks.
    """
    spark = pages.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rule_bounds(rules)
    tie = F.xxhash64("_path", *keep)
    rows = pages.select(*keep, url_host(F.col("url")).alias("_host"), url_path(F.col("url")).alias("_path"))
    rows = rows.select(F.struct(*keep, "_host", "_path").alias("page"), reversed_host(F.col("_host")).alias("key"), tie.alias("tie"))
    marks = bounds.select("key", F.lit(-(2**63)).cast("long").alias("tie"), "stack")
    events = rows.unionByName(marks, allowMissingColumns=True)
    dealt = cut(events.repartitionByRange(parts, "key", "tie").withColumn("part", F.spark_partition_id()), "sweep")

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
    ends = dealt.where("stack is not null").groupBy("part").agg(F.max_by("stack", "key").alias("end"))
    size = ends.agg(F.sum(F.aggregate("end", F.lit(0).cast("long"), lambda n, r: n + 64 + F.length(r["rule"]) * 4))).first()[0] or 0
    small = F.broadcast if size * parts <= BROADCAST_BYTES else (lambda df: df)  # a part may carry on the longest of the stacks
    carried = spark.range(parts).select(F.col("id").cast("int").alias("part")).join(small(ends), "part", "left")
    carried = carried.select("part", F.last("end", True).over(before).alias("carried"))

    sweep = Window.partitionBy("part").orderBy("key", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = dealt.withColumn("active", F.last("stack", True).over(sweep)).where("page is not null").join(small(carried), "part")
    active = F.coalesce("active", "carried")
    host, path = F.col("page._host"), F.col("page._path")
    fits = F.filter(active, lambda r: path.startswith(r["path"]) & ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))))
    won = F.get(fits, F.lit(0))
    return swept.select(
        *[F.col(f"page.{c}").alias(c) for c in keep],
        host.alias("host"),
        path.alias("path"),
        won["rule"].alias("rule"),
        F.coalesce(won["verdict"], F.lit(default)).alias("verdict"),
    )
