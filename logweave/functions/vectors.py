"""Vector arithmetic on array columns, in double precision, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(_d(a), _d(b), lambda x, y: x * y))


def squared_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(_d(v), lambda x: x * x)))


def mean(v: Column) -> Column:
    return total(_d(v)) / F.size(v)


def normalized(v: Column) -> Column:
    """The vector at unit length; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n > 0, F.transform(_d(v), lambda x: x / n)).otherwise(_d(v))


def similarity(d2: Column) -> Column:
    """Similarity of unit vectors from their squared distance, not below zero."""
    return F.greatest(F.lit(0.0), 1 - d2 / 2)
