"""Evaluation of scored rows: histograms, survival, ranking areas, averages, running statistics, retrieval statistics.

Nothing raises on empty, constant or one-class input: a share of nothing is null, or 0 where the docstring says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quoin.operators.metrics import cumulative_counts, pr_curve
from quoin.operators.scans import running  # noqa: F401


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin, n over equal widths from minimum to maximum, the last bin closed; a constant column is all in bin 0, nulls are left out."""
    edge = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    # one row
    place = F.floor(F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo")) * bins)
    known = df.select(value).where(F.col(value).isNotNull()).join(F.broadcast(edge))
    return known.groupBy(F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def survival(df: DataFrame, score: Column, thresholds: list[float]) -> DataFrame:
    """threshold, share of rows with a higher score; one pass whatever the number of thresholds."""
    shares = df.agg(*[F.avg((score > t).cast("double")).alias(f"t{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("share")) for i, t in enumerate(thresholds)])
    return shares.select(F.inline(rows))


def ranking_areas(df: DataFrame, score: Column, positive: Column) -> DataFrame:
    """auc (ties count half) and average_precision (sum of recall steps times precision); null where a class is missing."""
    per = cumulative_counts(df, score, positive)
    pos, neg = F.sum("p"), F.sum(F.col("n") - F.col("p"))
    won = F.sum((F.col("n") - F.col("p")) * (F.col("tp") - F.col("p") / 2))
    return per.agg(F.try_divide(won, pos * neg).alias("auc"), F.try_divide(F.sum(F.col("p") * F.try_divide("tp", "seen")), pos).alias("average_precision"))


def best_f1(df: DataFrame, score: Column, positive: Column, digits: int | None = None) -> DataFrame:
    """threshold, f1 of the best threshold, the smallest of equal ones; an undefined f1 counts as 0; null without rows."""
    both = F.col("precision") + F.col("recall")
    f1 = F.coalesce(F.round(F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both), 9), F.lit(0.0))
    best = F.max(F.struct(f1.alias("f1"), (-F.col("threshold")).alias("t")))
    return pr_curve(df, score, positive, digits).agg(best.alias("b")).select((-F.col("b.t")).alias("threshold"), "b.f1")


def averages(df: DataFrame, group: str, hit: Column) -> DataFrame:
    """macro (mean of group shares) and micro (share of all) averages."""
    per = df.groupBy(group).agg(F.count_if(hit).alias("found"), F.count("*").alias("total"))
    return per.agg(F.avg(F.try_divide("found", "total")).alias("macro"), F.try_divide(F.sum("found"), F.sum("total")).alias("micro"))


def recall_grid(hits: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """group, k, found, total, recall: hits (query_id, rank, relevant) among the first k out of min(n, k), for queries of truth (query_id, group, n); a recall of nothing is 0."""
    at = F.array(*[F.struct(F.lit(k).alias("k"), F.count_if(F.col("relevant") & (F.col("rank") <= k)).alias("found")) for k in ks])
    per = truth.join(hits, "query_id", "left").groupBy("query_id", "group", "n").agg(at.alias("a")).select("group", "n", F.inline("a"))
    out = per.groupBy("group", "k").agg(F.sum("found").alias("found"), F.sum(F.least("n", "k")).cast("long").alias("total"))
    return out.withColumn("recall", F.coalesce(F.try_divide("found", "total"), F.lit(0.0)))


def macro_recall(grid: DataFrame) -> DataFrame:
    """k, macro (mean over groups), micro (share of all): of recall_grid()."""
    return grid.groupBy("k").agg(F.avg("recall").alias("macro"), F.coalesce(F.try_divide(F.sum("found"), F.sum("total")), F.lit(0.0)).alias("micro"))


def similarity_spread(hits: DataFrame, k: int) -> DataFrame:
    """Means over queries of the smallest, largest and range of similarity and of distance (1 - similarity) among the first k."""
    per = hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.min("sim").alias("lo"), F.max("sim").alias("hi"))
    return per.agg(F.avg("lo").alias("min_sim"), F.avg("hi").alias("max_sim"), F.avg(F.col("hi") - F.col("lo")).alias("range"), F.avg(1 - F.col("hi")).alias("min_distance"), F.avg(1 - F.col("lo")).alias("max_distance"))


def hit_positions(hits: DataFrame) -> DataFrame:
    """query_id, positions: 0-based ranks of its relevant rows, ascending; queries without any have none."""
    return hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.when(F.col("relevant"), F.col("rank") - 1))).alias("positions"))
