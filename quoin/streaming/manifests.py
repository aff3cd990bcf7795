"""Scored manifests and events as streams: new files are picked up, scored lines parsed as in batch, windows closed by watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def scored_lines(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """path, score of lines `path,score` of new files in the folder; other lines are left out."""
    cells = F.split("value", ",")
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return lines.select(F.get(cells, 0).alias("path"), F.trim(F.get(cells, 1)).try_cast("double").alias("score")).where("path <> '' AND score IS NOT NULL")


def window_counts(events: DataFrame, time: str, by: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """by, start, n: events per window, which is final once the watermark has passed it; later events are dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def run_batches(stream: DataFrame, checkpoint: str, then: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Gives each micro-batch to a batch function, with all that is there now; a batch may come again after a failure, with its number."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(then).start()
