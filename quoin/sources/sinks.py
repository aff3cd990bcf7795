"""Sinks: wide neighbour rows, one folder per key, annotations, long metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def wide_rows(ranked: DataFrame, k: int, digits: int = 4, sep: str = "|", query: str = "query", item: str = "candidate", score: str = "score") -> DataFrame:
    """query, row: query, its candidates and their scores by rank, one text; ranked: rank from 1, of which those up to k count."""
    per = ranked.where(F.col("rank") <= k).groupBy(query).agg(F.sort_array(F.collect_list(F.struct("rank", F.col(item).cast("string").alias("i"), F.col(score).alias("s")))).alias("b"))
    cells = F.concat(F.array(F.col(query).cast("string")), F.col("b.i"), F.transform("b.s", lambda s: F.format_string(f"%.{digits}f", s)))
    return per.select(query, F.array_join(cells, sep).alias("row"))


def write_lines(lines: DataFrame, column: str, path: str) -> None:
    lines.select(column).write.mode("overwrite").text(path)


def write_by_key(df: DataFrame, key: str, path: str) -> None:
    """One folder per key; readers that ask for a key read its folder only. Rows of a key meet in one task's file or few, not in one of each task."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).parquet(path)


def write_annotations(df: DataFrame, path: str, row: str, column: str) -> None:
    """JSON lines and CSV of row and column, in order of the row's number."""
    ordered = df.select(F.col(row).cast("int").alias("row"), F.col(column).alias("column")).orderBy("row")
    ordered.write.mode("overwrite").json(f"{path}/json")
    ordered.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")


def long_metrics(df: DataFrame, run: Column, epoch: Column, metrics: dict[str, Column]) -> DataFrame:
    """run, epoch, metric, value: one row per metric."""
    each = F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in metrics.items()])
    return df.select(run.alias("run"), epoch.alias("epoch"), F.inline(each))
