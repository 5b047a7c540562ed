"""Naming a value inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once per row however often it is used, also where a filter is pushed down."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
