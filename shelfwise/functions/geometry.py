"""Polygons as arrays of [x, y]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(points: Column) -> Column:
    """Shoelace area; fewer than three points have none."""
    after = F.concat(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1))
    cross = F.zip_with(points, after, lambda p, q: (p[0] * q[1] - q[0] * p[1]).cast("double"))
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2


def box(points: Column) -> Column:
    """Smallest box: x0, y0, x1, y1."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes; 0 where the union is empty."""
    side = lambda lo, hi: F.greatest(F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]), F.lit(0)).cast("double")
    size = lambda x: ((x["x1"] - x["x0"]) * (x["y1"] - x["y0"])).cast("double")
    both = side("x0", "x1") * side("y0", "y1")
    union = size(a) + size(b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def turn(a: Column, b: Column, p: Column) -> Column:
    return F.signum(((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])).cast("double"))


def crosses(a: Column, b: Column, p: Column, q: Column) -> Column:
    """Whether two segments cross strictly."""
    return (turn(a, b, p) * turn(a, b, q) < 0) & (turn(p, q, a) * turn(p, q, b) < 0)


def valid_quad(points: Column, most: int = 1000) -> Column:
    """Four points within 0 to most, three distinct at least, of some area and not crossing themselves."""
    inside = F.forall(points, lambda p: (F.size(p) == 2) & (p[0] >= 0) & (p[0] <= most) & (p[1] >= 0) & (p[1] <= most))
    simple = ~crosses(points[0], points[1], points[2], points[3]) & ~crosses(points[1], points[2], points[3], points[0])
    return F.coalesce((F.size(points) == 4) & inside & (F.size(F.array_distinct(points)) >= 3) & (area(points) > 0) & simple, F.lit(False))
