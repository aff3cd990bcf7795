"""Prefix scans over an order that no single task holds: as-of joins and running statistics, with or without a key.

Rows are dealt to ranges of (key, order) and scanned range by range. What a range hands on to the later ones is one row for
each key in it that goes on in another range, at most two a range. So neither a key with most of the rows nor having no
key at all puts rows into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quoin.sources.storage import shared_path

#: A key with more rows than this, and more than its share of a few tasks, is scanned in ranges.
LARGE = 1 << 20


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """df with __range, the number of a range of (by, order), written to the shared folder; equal rows of an order may be in several ranges if their hash, the last of the order, differs."""
    path = shared_path(df.sparkSession, "ranges")
    df.repartitionByRange(_parts(df), *by, *order).withColumn("__range", F.spark_partition_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def numbered(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """df with the place of each row in order, from 1 without gaps, and the number of rows; equal rows of an order are numbered in any way, but once."""
    placed = ranged(df, [], order)
    sizes = dict(placed.groupBy("__range").agg(F.count("*")).collect())  # one row a range
    before, total = {}, 0
    for r in sorted(sizes):
        before[r] = total
        total += sizes[r]
    offset = F.create_map(*[F.lit(x) for r, n in before.items() for x in (r, n)])[F.col("__range")] if before else F.lit(0)
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) + offset
    return placed.withColumn(name, place.cast("long")).drop("__range"), total


def has_large_key(df: DataFrame, by: str) -> bool:
    """Whether one key has so many rows that its task would be far longer than the others."""
    per = df.groupBy(by).agg(F.count("*").alias("n"))
    most, total = per.agg(F.max("n"), F.sum("n")).first()
    return (most or 0) > max(LARGE, 4 * (total or 0) // _parts(df))


def handed_on(placed: DataFrame, by: list[str], state: dict[str, Column]) -> DataFrame:
    """by, __range, before: states of each earlier range that holds the key, as an array of structs in order of the range; keys of one range only are left out."""
    edges = placed.groupBy(*by, "__range").agg(*[c.alias(name) for name, c in state.items()])
    keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    on = F.col("a.__range") < F.col("b.__range")
    for k in keys:
        on = on & k
    if by:
        spans = edges.groupBy(*by).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
        cond = [edges[c].eqNullSafe(spans[c]) for c in by]
        joined = cond[0]
        for c in cond[1:]:
            joined = joined & c
        edges = edges.join(spans, joined, "left_semi")
    pairs = edges.alias("b").join(edges.alias("a"), on)  # at most two rows a range on each side
    states = F.sort_array(F.collect_list(F.struct(F.col("a.__range").alias("range"), *[F.col(f"a.{s}").alias(s) for s in state])))
    return pairs.groupBy(*[F.col(f"b.{c}").alias(c) for c in by], F.col("b.__range").alias("__range")).agg(states.alias("before"))


def _with_before(placed: DataFrame, before: DataFrame, by: list[str]) -> DataFrame:
    told = before.select(*[F.col(c).alias(f"__{c}") for c in by], F.col("__range").alias("__at"), "before")
    on = placed["__range"] == told["__at"]
    for c in by:
        on = on & placed[c].eqNullSafe(told[f"__{c}"])
    # one row for each range and key that began before it: at most one a range
    return placed.join(F.broadcast(told), on, "left").drop("__at", *[f"__{c}" for c in by])


def carry_last(df: DataFrame, by: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with name: the value of the last row up to this one in which it isn't null."""
    placed = ranged(df, by, order)
    place = F.when(F.col(value).isNotNull(), F.struct(*order))
    before = handed_on(placed, by, {"last": F.max_by(value, place)})
    w = Window.partitionBy("__range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    known = F.filter("before", lambda x: x["last"].isNotNull())
    # Window groups by range, so the longest sort is a range
    out = placed.withColumn("__own", F.last(value, ignorenulls=True).over(w))
    return _with_before(out, before, by).withColumn(name, F.coalesce("__own", F.try_element_at(known, F.lit(-1))["last"])).drop("__own", "__range", "before")


def running(df: DataFrame, by: str | None, order: list[str], value: str, last: int, whole: bool | None = None) -> DataFrame:
    """df with running_best and the mean of the last rows (this one included), within each `by`, or over all rows.

    whole: scan each key in one task; by default so unless there is no key or a key is very large. The result is the same.
    """
    if whole is None:
        whole = by is not None and not has_large_key(df, by)
    if whole:
        w = Window.partitionBy(*([by] if by else [])).orderBy(*order)
        return df.withColumns({"running_best": F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), "running_mean": F.avg(value).over(w.rowsBetween(1 - last, 0))})
    keys = [by] if by else []
    placed = ranged(df, keys, order)
    w = Window.partitionBy("__range", *keys).orderBy(*order)
    back = Window.partitionBy("__range", *keys).orderBy(*[F.desc(c) for c in order])
    ends = placed.withColumn("__back", F.row_number().over(back))
    tail = F.when(F.col("__back") < last, F.struct((-F.col("__back")).alias("at"), F.col(value).cast("double").alias("v")))
    before = handed_on(ends, keys, {"best": F.max(value), "tail": F.transform(F.sort_array(F.collect_list(tail)), lambda x: x["v"])})
    own = placed.withColumns({"__best": F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), "__sum": F.sum(F.col(value).cast("double")).over(w.rowsBetween(1 - last, 0)), "__n": F.count(value).over(w.rowsBetween(1 - last, 0)), "__at": F.row_number().over(w)})
    own = own.withColumnRenamed("__at", "__place")
    out = _with_before(own, before, keys)
    earlier = F.flatten(F.transform("before", lambda x: x["tail"]))
    missing = F.greatest(F.lit(last) - F.col("__place"), F.lit(0))
    start = F.greatest(F.size(earlier) - missing + 1, F.lit(1))
    more = F.filter(F.when(missing > 0, F.slice(earlier, start, missing)), lambda v: v.isNotNull())
    more = F.coalesce(more, F.array().cast("array<double>"))
    total = F.coalesce("__sum", F.lit(0.0)) + F.aggregate(more, F.lit(0.0), lambda a, v: a + v)
    best = F.array_max(F.transform("before", lambda x: x["best"]))
    out = out.withColumns({"running_best": F.greatest("__best", best), "running_mean": F.try_divide(total, F.col("__n") + F.size(more))})
    return out.drop("__best", "__sum", "__n", "__place", "__range", "before")
