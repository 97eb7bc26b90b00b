"""Column expressions on arrays of numbers, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: Column) -> Column:
    return c.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def normalized(a: Column) -> Column:
    n = norm(a)
    return F.transform(_d(a), lambda x: x / n)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(_d(a), _d(b), lambda x, y: x - y)


def scaled(a: Column, by: Column) -> Column:
    return F.transform(_d(a), lambda x: x * by)
