"""Vector expressions on array<float>, summed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column, zero_raises: bool = True) -> Column:
    n = norm(a)
    n = F.when(n > 0, n).otherwise(F.raise_error(F.lit("zero vector")).cast("double") if zero_raises else F.lit(1.0))
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def dual_view(a: Column, b: Column) -> Column:
    """Two views of equal weight as one unit vector."""
    return F.transform(F.concat(normalized(a, False), normalized(b, False)), lambda x: x / F.sqrt(F.lit(2.0)))
