"""Scalar functions on array<double> columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms below this count as this, so a zero vector has cosine distance 1 and not NaN.
NORM_FLOOR = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(NORM_FLOOR))
    return F.transform(a, lambda x: x / n)


def cosine_distance(a: Column, b: Column) -> Column:
    cosine = dot(a, b) / (F.greatest(norm(a), F.lit(NORM_FLOOR)) * F.greatest(norm(b), F.lit(NORM_FLOOR)))
    return 1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


METRICS: dict[str, Callable[[Column, Column], Column]] = {"cosine": cosine_distance, "euclidean": euclidean_distance, "l2": euclidean_distance}


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(sorted(METRICS))}")
    return METRICS[metric](a, b)
