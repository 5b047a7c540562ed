"""Rates, intervals and comparisons (NUM-*, AGG-06)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 1.959963984540054


def rate(part: Column, whole: Column) -> Column:
    """AGG-06: part / whole, null for 0 / 0 and any other division by zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def wilson(successes: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """NUM-01: the Wilson interval as (low, high), null for n = 0."""
    p = rate(successes, n)
    scale = 1 + F.try_divide(F.lit(z * z), n.cast("double"))
    centre = (p + F.try_divide(F.lit(z * z), 2.0 * n)) / scale
    half = z * F.sqrt(F.try_divide(p * (1 - p), n.cast("double")) + F.try_divide(F.lit(z * z), 4.0 * n * n)) / scale
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.when(n > 0, low), F.when(n > 0, high)


def close(a: Column, b: Column, absolute: float = 1e-6, relative: float = 1e-5) -> Column:
    """NUM-02: equal within tolerance; null only equals null."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) <= absolute + relative * F.abs(b))


def finite(x: Column) -> Column:
    """NUM-03: neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def target_sizes(n: Column, validation: float = 0.15, test: float = 0.2) -> tuple[Column, Column]:
    """NUM-04: (test, validation) sizes, rounded half to even; at least one test record."""
    return F.greatest(F.lit(1), F.bround(n * test).cast("long")), F.bround(n * validation).cast("long")
