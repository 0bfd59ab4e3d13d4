"""Scalar expressions on arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    """Dot product over norms, with 1e-9 under the first root; null if the second vector is zero."""
    guard = F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))) + 1e-9)
    return F.try_divide(dot(a, b), guard * norm(b))


def bound(value: Column, use) -> Column:
    """use(value) with value computed once, however often use names it or a lambda inside runs."""
    return F.element_at(F.transform(F.array(value), use), 1)


def softmax(a: Column) -> Column:
    e = bound(F.array_max(a), lambda top: F.transform(a, lambda x: F.exp(x.cast("double") - top)))
    return bound(e, lambda v: bound(_sum(v), lambda total: F.transform(v, lambda x: x / total)))


def f1(p: Column, r: Column) -> Column:
    return 2 * p * r / (p + r + 1e-9)
