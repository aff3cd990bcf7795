"""Images as rows of pixels: thresholds from histograms, moments, sheared extents. Everything is grouped sums; an image is never held as one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WHITE, NO_THRESHOLD = 255, 127


def pixels(df: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """key, x, y, value: one row for each entry of an array in row-major order."""
    return df.select(key, F.posexplode(values).alias("at", "value")).select(key, (F.col("at") % width).alias("x"), F.floor(F.col("at") / width).cast("int").alias("y"), "value")


def thresholds(df: DataFrame, key: str, value: str, white: int = WHITE, fallback: int = NO_THRESHOLD) -> DataFrame:
    """key, threshold: by the greatest variance between the classes up to and above it, over all values (whole numbers) below white.

    An image of one value has that as its threshold. One without any value below white has no histogram, so that neither
    this rule nor that of the minimum between two modes gives a threshold: it gets the fallback. Nulls count as white. Of equal variances the
    smallest value is taken; the variance is exact but for one division.
    """
    keys = df.select(key).distinct()
    counts = df.where(F.col(value) < white).groupBy(key, F.col(value).cast("long").alias("v")).agg(F.count("*").alias("n"))
    # at most `white` rows a key from here on
    up = Window.partitionBy(key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(key)
    mass = F.col("v") * F.col("n")
    sums = counts.select(key, "v", F.sum("n").over(up).alias("w1"), F.sum(mass).over(up).alias("s1"), F.sum("n").over(every).alias("w"), F.sum(mass).over(every).alias("s"))
    w2, s2 = F.col("w") - F.col("w1"), F.col("s") - F.col("s1")
    apart = (F.col("s1") * w2 - s2 * F.col("w1")).cast("double")
    between = F.when(w2 > 0, apart * apart / (F.col("w1") * w2).cast("double"))
    best = sums.groupBy(key).agg(F.max_by("v", F.struct(F.coalesce(between, F.lit(-1.0)).alias("b"), (-F.col("v")).alias("v"))).alias("__t"))
    out = keys.join(best.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key")), "left")
    return out.select(key, F.coalesce("__t", F.lit(fallback).cast("long")).alias("threshold"))


def moments(df: DataFrame, key: str, x: str = "x", y: str = "y", value: str = "value") -> DataFrame:
    """key, mass, cx, cy (centroid), u20, u11, u02 (central moments), major, minor (axis lengths), angle, horizontal_shear, vertical_shear; what is divided by nothing is null."""
    v, px, py = F.col(value).cast("double"), F.col(x).cast("double"), F.col(y).cast("double")
    s = df.groupBy(key).agg(F.sum(v).alias("mass"), F.sum(v * px).alias("a"), F.sum(v * py).alias("b"), F.sum(v * px * px).alias("aa"), F.sum(v * px * py).alias("ab"), F.sum(v * py * py).alias("bb"))
    per = lambda c: F.try_divide(F.col(c), F.col("mass"))
    s = s.select(key, "mass", per("a").alias("cx"), per("b").alias("cy"), per("aa").alias("aa"), per("ab").alias("ab"), per("bb").alias("bb"))
    s = s.select(key, "mass", "cx", "cy", (F.col("aa") - F.col("cx") * F.col("cx")).alias("u20"), (F.col("ab") - F.col("cx") * F.col("cy")).alias("u11"), (F.col("bb") - F.col("cy") * F.col("cy")).alias("u02"))
    half, spread = (F.col("u20") + F.col("u02")) / 2, F.hypot(2 * F.col("u11"), F.col("u20") - F.col("u02")) / 2
    root = lambda c: F.sqrt(F.greatest(c, F.lit(0.0)))
    return s.select(
        "*", root(half + spread).alias("major"), root(half - spread).alias("minor"), (F.atan2(2 * F.col("u11"), F.col("u20") - F.col("u02")) / 2).alias("angle"),
        F.try_divide("u11", "u02").alias("horizontal_shear"), F.try_divide("u11", "u20").alias("vertical_shear"),
    )


def _quantiles(steps: DataFrame, key: str, shares: dict[str, float], last: str) -> DataFrame:
    """steps: key, t (the place from which on mass counts), mass, last (the last place). Where the share of all mass that counts before a place reaches each share, between places in proportion."""
    up = Window.partitionBy(key).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    cum = steps.select(key, "t", last, "mass", F.sum("mass").over(up).alias("upto"), F.sum("mass").over(Window.partitionBy(key)).alias("all")).where("mass <> 0")
    after, before = F.col("upto") / F.col("all"), (F.col("upto") - F.col("mass")) / F.col("all")
    place = lambda f: F.when(F.col("t") <= 0, 0.0).otherwise(F.col("t") - 1 + F.try_divide(F.lit(f) - before, after - before))
    first = lambda f: F.min_by(place(f), F.when((after > f) & (F.col("t") <= F.col(last)), F.col("t")))
    return cum.groupBy(key, last).agg(*[F.coalesce(first(f), F.col(last).cast("double")).alias(name) for name, f in shares.items()])


def parallelogram(df: DataFrame, key: str, discard: float, x: str = "x", y: str = "y", value: str = "value") -> DataFrame:
    """key, left, right, top, bottom, shear, middle: the bounding parallelogram along the horizontal shear that leaves out that share of the mass in each direction.

    Its corners are (left or right + shear * (edge - middle), edge) for edge top and bottom. Places are those of pixels of all rows, values are not negative; images without mass or height have none.
    """
    m = moments(df, key, x, y, value).where("horizontal_shear IS NOT NULL").select(F.col(key).alias("__key"), F.col("horizontal_shear").alias("shear"), F.col("cy").alias("middle"))
    size = df.groupBy(F.col(key).alias("__of")).agg(F.max(x).cast("long").alias("x_last"), F.max(y).cast("long").alias("y_last"))
    rows = df.join(m, F.col(key).eqNullSafe(F.col("__key"))).join(size, F.col(key).eqNullSafe(F.col("__of")))
    sheared = F.col(x) + 0.5 - F.col("shear") * (F.col(y) - F.col("middle"))
    steps = lambda at, last: rows.groupBy(key, last, F.greatest(F.floor(at) + 1, F.lit(0)).cast("long").alias("t")).agg(F.sum(F.col(value).cast("double")).alias("mass"))
    shares = lambda a, b: {a: discard / 2, b: 1 - discard / 2}
    h = _quantiles(steps(F.round(sheared, 9), "x_last"), key, shares("left", "right"), "x_last").drop("x_last")
    v = _quantiles(steps(F.col(y).cast("double"), "y_last"), key, shares("top", "bottom"), "y_last").drop("y_last")
    same = lambda df, name: F.col("__key").eqNullSafe(F.col(name))
    h, v = h.withColumnRenamed(key, "__h"), v.withColumnRenamed(key, "__v")
    return m.join(h, same(h, "__h")).join(v, same(v, "__v")).select(F.col("__key").alias(key), "left", "right", "top", "bottom", "shear", "middle")
