"""Vector functions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """The vector at unit length; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either has no length."""
    n = norm(a) * norm(b)
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def axis_position(v: Column, low: Column, high: Column) -> Column:
    """Place of ``v`` between two poles along their axis, from 0 to 1; 0 for equal poles."""
    axis = F.zip_with(high, low, lambda x, y: x.cast("double") - y.cast("double"))
    from_low = F.zip_with(v, low, lambda x, y: x.cast("double") - y.cast("double"))
    length = dot(axis, axis)
    at = F.when(length == 0, 0.0).otherwise(dot(from_low, axis) / length)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), at))
