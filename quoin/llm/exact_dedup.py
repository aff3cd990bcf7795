"""Exact deduplication: group by 128-bit content hash, compare bytes inside groups, keep the best row.

Texts are equal when identical after deleting every white-space character of [\\x20\\x09-\\x0D]. Of equal
texts the row with the most code points in its original text stays, then the one with the smallest id.

Defined results: a null text counts as empty, so null and blank texts form one group; a null id ranks after
every other id; rows that repeat an id are rows of their own and are all marked kept if that id stays; an empty
table gives an empty result; columns other than the two named are not read.

Shape of the plan: texts are hashed to a narrow row each, and hashes counted with map-side combine. Only texts whose hash
repeats are compared by their bytes, grouped by (hash, text), so that copies meet once per task; a bitmap of fixed size
keeps nearly all others out of that shuffle. One row per group goes back to the ids by hash, in several parts where very many
rows share it. Texts that differ under one hash need a second, byte-keyed join, and that is planned only if there are such.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import SPACE, bitmap, join_to_groups, materialize, may_be_in, md5_128, table, text_or_empty


def _big(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def _rank(length: Column, doc_id: Column) -> Column:
    """One decimal that orders by length, then by smaller id, so that a hash aggregate can take its maximum."""
    turned = _big(2**63) - doc_id.cast("decimal(20,0)")
    return (length.cast("decimal(10,0)") * _big(2**65) + F.coalesce(turned, F.lit(0))).cast("decimal(38,0)")


def _ranked_id(rank: Column) -> Column:
    turned = (rank % _big(2**65)).cast("decimal(38,0)")
    return F.when(turned > 0, (_big(2**63) - turned).cast("long"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash128: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256."""
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(text).alias("length"), F.regexp_replace(text, f"[{SPACE}]+", "").alias("body"))
    rows = rows.select("doc_id", "length", "body", hash128(F.col("body")).alias("h"))
    rows = rows.withColumn("x", F.xxhash64("h"))
    counted = [F.count("*").alias("n"), F.max(_rank(F.col("length"), F.col("doc_id"))).alias("best")]
    groups = materialize(rows.groupBy("h").agg(*counted).where("n > 1"))
    bits = bitmap(groups.select(F.xxhash64("h").alias("x")))
    by_bytes = may_be_in(rows, "x", bits).groupBy("h", "body").agg(*counted)
    mixed = materialize(by_bytes.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h"))
    light = rows.select("doc_id", "h", "x", F.sha2("body", 256).alias("text_sha256"))
    single = [F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.col("text_sha256")]
    of_group = [F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(_ranked_id(F.col("best"))).alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), F.col("text_sha256")]
    result = may_be_in(light, "x", bits, negate=True).select("doc_id", *single)
    if mixed.isEmpty():
        result = result.unionByName(join_to_groups(may_be_in(light, "x", bits), groups, "h", "n", "left").select("doc_id", *of_group))
    else:
        same = join_to_groups(may_be_in(light, "x", bits).join(mixed, "h", "left_anti"), groups, "h", "n", "left")
        apart = may_be_in(rows, "x", bits).join(mixed, "h", "left_semi").join(by_bytes.join(mixed, "h", "left_semi"), ["h", "body"])
        result = result.unionByName(same.select("doc_id", *of_group)).unionByName(apart.withColumn("text_sha256", F.sha2("body", 256)).select("doc_id", *of_group))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
), k AS (
  SELECT body, arg_min(doc_id, (-n, doc_id)) AS keep_id, count(*) AS group_size FROM d GROUP BY body
)
SELECT d.doc_id, k.keep_id, k.group_size, d.doc_id = k.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN k ON d.body = k.body
"""
