"""Boxes as arrays [x0, y0, x1, y1] (GEO-*)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import finite


def clip(xs: Column, ys: Column, width: Column, height: Column) -> Column:
    """GEO-01: the hull of corner arrays clipped to the page; null if nothing is left."""
    x0, y0 = F.greatest(F.lit(0.0), F.array_min(xs)), F.greatest(F.lit(0.0), F.array_min(ys))
    x1, y1 = F.least(width.cast("double"), F.array_max(xs)), F.least(height.cast("double"), F.array_max(ys))
    return F.when((x1 > x0) & (y1 > y0), F.array(x0, y0, x1, y1))


def to_grid(box: Column, width: Column, height: Column) -> Column:
    """GEO-02: pixels to the 0..1000 grid, truncated."""
    return F.array(*[(1000 * (box[i] / (width, height)[i % 2])).cast("int") for i in range(4)])


def union_box(boxes: Column) -> Column:
    """GEO-03: the smallest box around all boxes of an array."""
    side = [lambda i, f: f(F.transform(boxes, lambda b: b[i]))][0]
    return F.array(side(0, F.array_min), side(1, F.array_min), side(2, F.array_max), side(3, F.array_max))


def overlap_share(box: Column, region: Column) -> Column:
    """GEO-04: intersection over the box's own area, 0 for a box without area."""
    wide = F.greatest(F.lit(0.0), F.least(box[2], region[2]) - F.greatest(box[0], region[0]))
    high = F.greatest(F.lit(0.0), F.least(box[3], region[3]) - F.greatest(box[1], region[1]))
    area = (box[2] - box[0]) * (box[3] - box[1])
    return F.when(area <= 0, F.lit(0.0)).otherwise(F.try_divide(wide * high, area))


def valid_box(box: Column, width: Column, height: Column, strict: bool = True) -> Column:
    """GEO-05: four finite numbers inside the page; strict: with an area."""
    numbers = F.forall(box, finite)
    order = (box[0] < box[2]) & (box[1] < box[3]) if strict else (box[0] <= box[2]) & (box[1] <= box[3])
    return (F.size(box) == 4) & numbers & order & (box[0] >= 0) & (box[1] >= 0) & (box[2] <= width) & (box[3] <= height)


# The affine matrices of the eight EXIF orientations, as (a, b, c, d, e, f) with w and h for the page sides:
# x' = a x + b y + c, y' = d x + e y + f.
EXIF = {
    1: (1, 0, "0", 0, 1, "0"),
    2: (-1, 0, "w", 0, 1, "0"),
    3: (-1, 0, "w", 0, -1, "h"),
    4: (1, 0, "0", 0, -1, "h"),
    5: (0, 1, "0", 1, 0, "0"),
    6: (0, -1, "h", 1, 0, "0"),
    7: (0, -1, "h", -1, 0, "w"),
    8: (0, 1, "0", -1, 0, "w"),
}


def turn(box: Column, orientation: Column, width: Column, height: Column) -> Column:
    """GEO-06: a box after the page is turned upright by its EXIF orientation; null for an unknown one."""
    side = {"0": F.lit(0), "w": width, "h": height}
    out = None
    for k, (a, b, c, d, e, f) in EXIF.items():
        corners = [(a * box[i] + b * box[j] + side[c], d * box[i] + e * box[j] + side[f]) for i, j in ((0, 1), (2, 3))]
        (xa, ya), (xb, yb) = corners
        moved = F.array(F.least(xa, xb), F.least(ya, yb), F.greatest(xa, xb), F.greatest(ya, yb))
        out = F.when(orientation == k, moved) if out is None else out.when(orientation == k, moved)
    return out


def turned_size(orientation: Column, width: Column, height: Column) -> Column:
    """The page's size after turning: sides are swapped by orientations 5 to 8."""
    return F.when(orientation >= 5, F.array(height, width)).otherwise(F.array(width, height))


def snap(box: Column, width: Column, height: Column, columns: int = 4, rows: int = 8) -> Column:
    """GEO-07: the cell of a columns x rows grid that holds the box's centre."""
    w, h = width / columns, height / rows
    c = F.least(F.lit(columns - 1), F.floor((box[0] + box[2]) / 2 / w))
    r = F.least(F.lit(rows - 1), F.floor((box[1] + box[3]) / 2 / h))
    return F.array(c * w, r * h, (c + 1) * w, (r + 1) * h)
