"""Column expressions on score vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _let(value: Column, body) -> Column:
    """body of value, computed once: an expression that a lambda holds is computed for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def softmax(v: Column) -> Column:
    e = lambda m: F.transform(v, lambda x: F.exp(x - m))
    shares = lambda e: _let(F.aggregate(e, F.lit(0.0), lambda a, y: a + y), lambda s: F.transform(e, lambda x: x / s))
    return _let(_let(F.array_max(v), e), shares)


def argmax(v: Column) -> Column:
    """0-based place of the largest value; of equal ones the first."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def unit(v: Column) -> Column:
    """v over its length; a zero vector stays zero."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return _let(n, lambda s: F.transform(v, lambda x: F.coalesce(F.try_divide(x.cast("double"), s), F.lit(0.0))))


def product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, v: acc + v)


def distance(a: Column, b: Column) -> Column:
    """Euclidean; of flattened images the Frobenius distance."""
    return F.sqrt(squared_distance(a, b))


def exponential_kernel(a: Column, b: Column, width: float = 1.0) -> Column:
    return F.exp(-squared_distance(a, b) / (2.0 * width * width))


def rational_kernel(a: Column, b: Column, width: float = 1.0, alpha: float = 1.0) -> Column:
    return F.pow(1 + squared_distance(a, b) / (2.0 * alpha * width * width), F.lit(-alpha))


def polynomial_kernel(a: Column, b: Column, degree: int = 2, shift: float = 1.0) -> Column:
    return F.pow(product(a, b) + shift, F.lit(float(degree)))


def scott_width(n: int, dim: int) -> float:
    return n ** (-1.0 / (dim + 4))


def silverman_width(n: int, dim: int) -> float:
    return (n * (dim + 2) / 4.0) ** (-1.0 / (dim + 4))


def warmup_cosine(step: Column, warmup: int, total: int, peak: float, floor: float) -> Column:
    """A rate that rises in a line to its peak, then falls as a cosine to its floor."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (step - warmup) / float(max(1, total - warmup))))
    return F.when(step < warmup, F.lit(peak) * step / float(max(1, warmup))).otherwise(F.lit(floor) + 0.5 * (peak - floor) * (1 + F.cos(share * 3.141592653589793)))


def anchors(scales: list[float], ratios: list[float], size: float = 16.0) -> Column:
    """Boxes (scale, ratio, w, h) of area (size * scale)**2 and h / w = ratio, in order of ratio, then scale; explode it."""
    return F.array(*[F.struct(F.lit(float(s)).alias("scale"), F.lit(float(r)).alias("ratio"), F.lit(size * s / r**0.5).alias("w"), F.lit(size * s * r**0.5).alias("h")) for r in ratios for s in scales])
