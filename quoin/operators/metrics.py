"""Classifier metrics from scored rows. A share of nothing is null; nothing here raises on empty, constant or one-class input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quoin.operators.scans import ranged


def _cumulated(df: DataFrame, score: Column, positive: Column) -> tuple[DataFrame, int, int]:
    """cumulative_counts() with the numbers of positives and of rows."""
    per = df.groupBy(score.alias("s")).agg(F.sum(F.coalesce(positive, F.lit(False)).cast("long")).alias("p"), F.count("*").alias("n")).where("s IS NOT NULL")
    down = F.col("s").desc()
    placed = ranged(per, [], [down])
    sums = {r: (p, n) for r, p, n in placed.groupBy("__range").agg(F.sum("p"), F.sum("n")).collect()}  # one row a range
    before = {r: [sum(x[i] for q, x in sums.items() if q < r) for i in (0, 1)] for r in sums}
    earlier = lambda i: F.create_map(*[F.lit(x) for r in before for x in (r, before[r][i])])[F.col("__range")] if before else F.lit(0)
    within = Window.partitionBy("__range").orderBy(down).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.select("s", "p", "n", (earlier(0) + F.sum("p").over(within)).cast("long").alias("tp"), (earlier(1) + F.sum("n").over(within)).cast("long").alias("seen"))
    return out, sum(x[0] for x in sums.values()), sum(x[1] for x in sums.values())


def cumulative_counts(df: DataFrame, score: Column, positive: Column) -> DataFrame:
    """s, p, n, tp, seen: per distinct score its positives and rows, and both counted from the highest score down.

    Counts per score are dealt to ranges of scores and summed within them, on top of the sums of the ranges above, so no task holds all distinct scores.
    """
    return _cumulated(df, score, positive)[0]


def _share(value: Column, of: int) -> Column:
    return value / F.lit(of) if of else F.lit(None).cast("double")


def pr_curve(df: DataFrame, score: Column, positive: Column, digits: int | None = None) -> DataFrame:
    """threshold, tp, fp, precision, recall at each distinct score, rounded first if digits are given; recall is null without positives."""
    per, every, _ = _cumulated(df, score if digits is None else F.round(score, digits), positive)
    return per.select(F.col("s").alias("threshold"), "tp", (F.col("seen") - F.col("tp")).alias("fp"), F.try_divide("tp", "seen").alias("precision"), _share(F.col("tp"), every).alias("recall"))


def confusion(df: DataFrame, label: Column, predicted: Column, shares: bool = False) -> DataFrame:
    """label, predicted, n, and with shares the share of the label's rows."""
    out = df.groupBy(label.alias("label"), predicted.alias("predicted")).agg(F.count("*").alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("label"))) if shares else out


def at_threshold(df: DataFrame, score: Column, positive: Column, threshold: float) -> DataFrame:
    """precision, recall, f1 of score > threshold; undefined ones are 0."""
    called, right = score > threshold, (score > threshold) & positive
    c = df.agg(F.count_if(called).alias("c"), F.count_if(right).alias("r"), F.count_if(positive).alias("p"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return c.select(share(F.col("r"), F.col("c")).alias("precision"), share(F.col("r"), F.col("p")).alias("recall"), share(2.0 * F.col("r"), F.col("c") + F.col("p")).alias("f1"))


def best_accuracy(df: DataFrame, score: Column, positive: Column, thresholds: list[float]) -> DataFrame:
    """threshold, accuracy: the best of the thresholds and the median score, for score > threshold; of equal ones the smallest."""
    rows = df.select(score.alias("s"), positive.alias("y"))
    # one row
    with_median = rows.join(F.broadcast(rows.agg(F.median("s").alias("m"))))
    every = F.concat(F.array(*[F.lit(float(t)) for t in thresholds]), F.array(F.col("m")))
    right = with_median.select(F.explode(every).alias("threshold"), "s", "y").groupBy("threshold").agg(F.avg(((F.col("s") > F.col("threshold")) == F.col("y")).cast("double")).alias("accuracy"))
    best = F.max(F.struct(F.col("accuracy"), (-F.col("threshold")).alias("t")))
    return right.where("threshold IS NOT NULL").agg(best.alias("b")).select((-F.col("b.t")).alias("threshold"), "b.accuracy")


def precision_at_recalls(df: DataFrame, score: Column, positive: Column, recalls: list[float]) -> DataFrame:
    """target, precision: the highest precision of a threshold that reaches the recall; null where none does."""
    curve = pr_curve(df, score, positive)
    aims = F.array(*[F.struct(F.lit(float(r)).alias("target"), F.max(F.when(F.col("recall") >= r, F.col("precision"))).alias("precision")) for r in recalls])
    return curve.agg(aims.alias("a")).select(F.inline("a"))


def interpolated_precision(df: DataFrame, score: Column, positive: Column, recalls: list[float], margin: float = 0.01) -> DataFrame:
    """target, threshold, precision, recall, best, around the place of the curve where recall falls to target + margin.

    threshold: the highest one whose recall is above that, and best the highest precision down from there (the interpolated one); precision and recall: those
    at the next threshold up, where there is none 1 and 0, the curve's end.
    """
    curve = pr_curve(df, score, positive)
    above = lambda r: F.col("recall") > r + margin
    after = lambda r: F.min_by(F.struct("precision", "recall"), F.when(F.col("recall") <= r + margin, F.col("threshold")))
    aims = F.array(*[F.struct(F.lit(float(r)).alias("target"), F.max(F.when(above(r), F.col("threshold"))).alias("threshold"), after(r).alias("at"), F.max(F.when(above(r), F.col("precision"))).alias("best")) for r in recalls])
    out = curve.agg(aims.alias("a")).select(F.inline("a"))
    return out.select("target", "threshold", F.coalesce("at.precision", F.lit(1.0)).alias("precision"), F.coalesce("at.recall", F.lit(0.0)).alias("recall"), "best")


def error_tradeoff(df: DataFrame, score: Column, positive: Column) -> DataFrame:
    """threshold, false_positive_rate, false_negative_rate at each distinct score; null where a class is missing."""
    per, positives, rows = _cumulated(df, score, positive)
    return per.select(F.col("s").alias("threshold"), _share(F.col("seen") - F.col("tp"), rows - positives).alias("false_positive_rate"), _share(positives - F.col("tp"), positives).alias("false_negative_rate"))
