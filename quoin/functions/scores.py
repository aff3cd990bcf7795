"""Column expressions on vectors, distances and names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def rbf_affinity(distance: Column, sigma: float = 1.0, eps: float = 1.0, power: float = 2.0) -> Column:
    return F.exp(-F.pow(F.lit(eps) * distance, F.lit(power)) / F.lit(2.0 * sigma * sigma))


def in_half_open(value: Column, lo: Column, hi: Column) -> Column:
    return (value >= lo) & (value < hi)
