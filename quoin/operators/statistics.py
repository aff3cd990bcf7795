"""Statistics of columns: summaries, scaling, partial correlation, mutual information, kernel two-sample tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quoin.operators.ranking import ranked_by_seed
from quoin.operators.tiles import kernel_moments


def summary(df: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """n, mean, median, std (of the population), min and max per group."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def scaled(df: DataFrame, value: str, name: str = "scaled") -> DataFrame:
    """df with its value scaled to 0..1 over all rows; a constant column gives 0."""
    edge = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    # one row
    place = F.coalesce(F.try_divide(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.when(F.col(value).isNotNull(), 0.0))
    return df.join(F.broadcast(edge)).withColumn(name, place).drop("__lo", "__hi")


def inverted(df: DataFrame, distance: str, name: str = "affinity") -> DataFrame:
    """df with the largest distance minus its own."""
    # one row
    return df.join(F.broadcast(df.agg(F.max(distance).alias("__hi")))).withColumn(name, F.col("__hi") - F.col(distance)).drop("__hi")


def correlation(a: str, b: str) -> Column:
    """Pearson's r as an aggregate; null where a column is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def partial_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r: the correlation of each two columns given all others, from the inverse of their correlation matrix (of few columns, on the driver); null where that has none."""
    import numpy as np

    n = len(columns)
    known = df.dropna(subset=columns)
    row = known.agg(*[correlation(columns[i], columns[j]) for i in range(n) for j in range(i)]).first()
    gram, at = np.eye(n), 0
    for i in range(n):
        for j in range(i):
            gram[i, j] = gram[j, i] = np.nan if row[at] is None else row[at]
            at += 1
    if np.isnan(gram).any() or np.linalg.matrix_rank(gram) < n:
        inverse = np.full((n, n), np.nan)
    else:
        inverse = np.linalg.inv(gram)
    value = lambda i, j: float(-inverse[i, j] / np.sqrt(inverse[i, i] * inverse[j, j]))
    out = [(columns[j], columns[i], None if np.isnan(inverse[i, j]) else value(i, j)) for i in range(n) for j in range(i)]
    return df.sparkSession.createDataFrame(out, "a string, b string, r double")


def _place(value: str, bins: int) -> Column:
    at = F.floor(F.try_divide(F.col(value) - F.col(f"__lo_{value}"), F.col(f"__hi_{value}") - F.col(f"__lo_{value}")) * bins)
    return F.least(F.coalesce(at, F.lit(0)), F.lit(bins - 1)).cast("long")


def mutual_information(df: DataFrame, factor: str, values: list[str], bins: int = 20) -> DataFrame:
    """value, mi (in nats): of the factor and each column in equal-width bins."""
    edges = df.agg(*[x for v in values for x in (F.min(v).alias(f"__lo_{v}"), F.max(v).alias(f"__hi_{v}"))])
    # one row
    cells = F.array(*[F.struct(F.lit(v).alias("value"), _place(v, bins).alias("bin")) for v in values])
    counts = df.join(F.broadcast(edges)).select(F.col(factor).alias("factor"), F.inline(cells)).groupBy("value", "factor", "bin").agg(F.count("*").alias("n"))
    # contingency tables: factors times bins rows
    f = counts.groupBy("value", "factor").agg(F.sum("n").alias("nf"))
    b = counts.groupBy("value", "bin").agg(F.sum("n").alias("nb"))
    t = counts.groupBy("value").agg(F.sum("n").alias("nt"))
    both = counts.join(f, ["value", "factor"]).join(b, ["value", "bin"]).join(t, "value")
    return both.groupBy("value").agg(F.sum(F.col("n") / F.col("nt") * F.log(F.col("n") * F.col("nt") / (F.col("nf") * F.col("nb")))).alias("mi"))


def information_gap(df: DataFrame, factor: str, values: list[str], bins: int = 20) -> DataFrame:
    """gap: the largest mutual information of the factor less the second, over the factor's entropy; null if that is 0."""
    counts = df.groupBy(factor).agg(F.count("*").alias("n"))
    share = F.col("n") / F.col("t")
    # one row each
    entropy = counts.join(F.broadcast(counts.agg(F.sum("n").alias("t")))).agg((-F.sum(share * F.log(share))).alias("h"))
    two = mutual_information(df, factor, values, bins).agg(F.slice(F.reverse(F.sort_array(F.collect_list("mi"))), 1, 2).alias("m"))
    return two.join(F.broadcast(entropy)).select(F.try_divide(F.get("m", 0) - F.get("m", 1), F.col("h")).alias("gap"))


def linear_mmd(pairs: DataFrame, kernel) -> DataFrame:
    """mmd2, z: the linear-time estimate of the squared kernel distance of two samples, and it over its standard error.

    pairs: two rows of each sample a row (x1, x2, y1, y2); kernel(a, b): a Column.
    """
    x1, x2, y1, y2 = (F.col(c) for c in ("x1", "x2", "y1", "y2"))
    h = kernel(x1, x2) + kernel(y1, y2) - kernel(x1, y2) - kernel(x2, y1)
    return pairs.select(h.alias("h")).agg(F.avg("h").alias("mmd2"), F.try_divide(F.avg("h"), F.sqrt(F.try_divide(F.var_samp("h"), F.count("h")))).alias("z"))


def paired(x: DataFrame, y: DataFrame, key: str, vector: str, seed: int = 0) -> DataFrame:
    """at, x, y: the two samples in seeded order side by side, as many as the smaller one has."""
    side = lambda df, name: ranked_by_seed(df.select(key, vector), [], key, seed, "at").select("at", F.col(vector).alias(name))
    return side(x, "x").join(side(y, "y"), "at")


def quadratic_mmd(pairs: DataFrame, kernel: str = "exponential", sigma: float = 1.0, unbiased: bool = True) -> DataFrame:
    """mmd2, error: the quadratic-time estimate of the squared kernel distance of the samples x and y of pairs (at, x, y), and its standard error.

    The error is that of a U-statistic under equal samples, twice the variance of h over the number of pairs; null if biased.
    """
    mean = F.try_divide("total", "n")
    variance = 2 * F.try_divide(F.try_divide("squares", "n") - mean * mean, F.col("n"))
    error = F.sqrt(F.greatest(variance, F.lit(0.0))) if unbiased else F.lit(None).cast("double")
    return kernel_moments(pairs, kernel, sigma, unbiased).select(mean.alias("mmd2"), error.alias("error"))
