"""Mixing sources to target weights by capped water-filling.

Each source gets a share of all words in proportion to its weight, but never more than max_epochs times its own
size; what a capped source can't take is shared again by weight among the others until no source is above its cap. That
fixed point is found at once: in order of cap per weight, a source is capped exactly if the level that the remaining
words would reach over the remaining weights is at least its cap per weight.

A source's words come from floor(target / size) whole repetitions of each of its documents and one fractional repetition:
documents in the order of a seeded hash are taken once more until the target is reached, the last one in part (its
leading words). Running sums go over hash bins per source; only the bin that holds the cut is ordered row by row, so no
task holds a whole source.

Defined results: null text has size 0; null is a source of its own and comes last; a source of size 0 takes 0; an empty
table gives an empty result; rows that repeat an id are mixed as separate rows; columns other than the three named are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import materialize, n_words, table

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Hash bins per source, named by this many hex digits.
_BIN_DIGITS = 3


def capped_targets(sizes: DataFrame, weight: Column, max_epochs: float) -> DataFrame:
    """sizes: one row per source with source_size. Adds weight and target (words). One row per source goes through one task."""
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("place"))
    s = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    s = s.withColumn("weight", weight.cast("double")).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    s = s.withColumn("total", F.sum("source_size").over(everything))
    left = F.col("total") - F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("cap")
    over = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("capped", left * F.col("weight") >= F.col("cap") * over)
    spare = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0.0)).over(everything)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * spare / open_weight))
    return s.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, repeats (whole repetitions), part (leading words of one more), taken."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    sized = materialize(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("key")))
    sized = sized.withColumn("bin", F.substring("key", 1, _BIN_DIGITS))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    sources = capped_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), F.element_at(listed, ((F.col("place") - 1) % len(weights) + 1).cast("int")), max_epochs)
    sources = sources.withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    sources = sources.withColumn("extra", F.floor(F.col("target") - F.col("repeats") * F.col("source_size") + 0.5))
    bins = sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")).withColumnsRenamed({"source": "s"})
    bins = bins.withColumn("before", F.sum("bin_size").over(Window.partitionBy("s").orderBy("bin")) - F.col("bin_size"))
    cut = sources.join(bins, F.col("source").eqNullSafe(F.col("s")) & (F.col("before") < F.col("extra")) & (F.col("before") + F.col("bin_size") >= F.col("extra")), "left")
    plan = materialize(cut.select(F.col("source").alias("s"), "source_size", "target", "repeats", "extra", F.col("bin").alias("cut"), "before"))
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    whole = rows.where("cut IS NULL OR bin <> cut").withColumn("part", F.when(F.col("bin") < F.col("cut"), F.col("size")).otherwise(0))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = rows.where("bin = cut").withColumn("ahead", F.col("before") + F.sum("size").over(order) - F.col("size"))
    edge = edge.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("ahead")))).drop("ahead")
    out = whole.unionByName(edge).withColumn("part", F.col("part").cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", F.col("repeats").cast("long").alias("repeats"), "part", (F.col("repeats") * F.col("size") + F.col("part")).cast("long").alias("taken"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixing_sql(documents: str = "documents", seed: int = 7, columns: str = "doc_id, size, source_size, target, taken") -> str:
    """The same over a table or subquery named by documents, for DuckDB."""
    return rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat('{seed}:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS key FROM {documents}
), s0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), s1 AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s0
), s2 AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3.0::DOUBLE * source_size AS cap FROM s1
), s3 AS (
  SELECT *, (total - sum(cap) OVER (ORDER BY cap / weight, place ROWS UNBOUNDED PRECEDING) + cap) * weight
            >= cap * sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped FROM s2
), s4 AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE least(cap, weight * (total - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ())
         / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER ()) END AS target FROM s3
), s5 AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS repeats FROM s4
), r AS (
  SELECT d.*, s5.source_size, s5.target, s5.repeats, floor(target - repeats * source_size + 0.5) AS extra,
         sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS ahead
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source
), m AS (
  SELECT *, CAST(repeats * size + greatest(0, least(size, extra - ahead)) AS BIGINT) AS taken FROM r
)
SELECT {columns} FROM m
"""


SQL = mixing_sql()
