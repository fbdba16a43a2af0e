"""Vector arithmetic on array columns, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size)


def inside_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Whether a point lies inside a polygon of at least three corners, by the parity of crossed edges."""
    if len(corners) < 3:
        raise ValueError("a region has at least three corners")
    crossed = F.lit(0)
    for (xa, ya), (xb, yb) in zip(corners, [*corners[1:], corners[0]], strict=True):
        if ya == yb:
            continue
        spans = (F.lit(ya) > y) != (F.lit(yb) > y)
        meets = x < (xb - xa) * (y - ya) / (yb - ya) + xa
        crossed = crossed + (spans & meets).cast("int")
    return crossed % 2 == 1


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes, structs of x, y, width, height; two empty boxes have 0."""
    part = lambda p, s: F.greatest(F.lit(0), F.least(a[p] + a[s], b[p] + b[s]) - F.greatest(a[p], b[p])).cast("double")
    shared = part("x", "width") * part("y", "height")
    area = lambda r: r["width"].cast("double") * r["height"].cast("double")
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)
