"""Distances between float vectors as Column expressions; the shorter vector decides how far they go."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(x)).cast("float") for x in vector)).cast("array<float>")


def _fold(a: Column, b: Column, step: Callable[[Column, Column], Column]) -> Column:
    size = F.least(F.size(a), F.size(b))
    terms = F.zip_with(F.slice(a, 1, size), F.slice(b, 1, size), step)
    return F.aggregate(terms, F.lit(0).cast("float"), lambda s, x: (s + x).cast("float"))


def l1(a: Column, b: Column) -> Column:
    """Sum of absolute differences, added in order in single precision."""
    return _fold(a, b, lambda x, y: F.abs(x - y))


def l2_squared(a: Column, b: Column) -> Column:
    return _fold(a, b, lambda x, y: (x - y) * (x - y))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b)).cast("float")


METRICS: dict[str, Callable[[Column, Column], Column]] = {"l1": l1, "l2": l2, "l2_squared": l2_squared}
