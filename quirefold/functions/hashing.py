"""Digests and hash orders (HSH-*, WIN-11)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(value: Column) -> Column:
    """HSH-01: lower-case hex; a string is taken as UTF-8."""
    return F.sha2(value, 256)


def git_blob(value: Column) -> Column:
    """HSH-03: the id that git gives a blob with this content."""
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(value).cast("string")), "UTF-8"), F.unhex(F.lit("00")), F.encode(value, "UTF-8")))


def cache_key(**parts: Column) -> Column:
    """HSH-04: a digest of named strings and integers, in the order of their names."""
    return sha256(F.to_json(F.struct(*[parts[k].alias(k) for k in sorted(parts)])))


def hash_order(key: Column, tag: str) -> Column:
    """WIN-11: a fixed pseudo-random sort key of an id, different for each tag."""
    return sha256(F.concat(F.lit(f"{tag}|"), key.cast("string")))
