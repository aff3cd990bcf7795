"""Queries over the tables of a scale folder, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quoin.functions.scores import in_half_open, norm, rbf_affinity
from quoin.operators import evaluation, joins, manifest, metrics, ranking, retrieval
from quoin.plans import attribution, files, pairs, relations, scoring, selection
from quoin.sources.tables import table


def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return retrieval.knn(e.where("vec_id % 20 = 0"), e, 10).select("query_id", "id", F.round("sim", 5).alias("sim"))


def recall_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    labels = e.select(F.col("vec_id").alias("id"), F.col("label").alias("hit"))
    sizes = e.groupBy("label").agg((F.count("*") - 1).alias("n"))
    own = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label").join(sizes, "label")
    hits = retrieval.knn(e.where("vec_id % 20 = 0"), e, 10).join(labels, "id").join(own.drop("n"), "query_id").select("query_id", F.col("label").alias("group"), (F.col("hit") == F.col("label")).alias("relevant"), "rank")
    return retrieval.recall_at(hits, own.select("query_id", "n"), 10).withColumnRenamed("group", "label")


def vector_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", norm(F.col("embedding")).alias("length"))
    return e.select("vec_id", F.round("length", 5).alias("length"), F.round(rbf_affinity(F.col("length"), 2.0), 5).alias("affinity"))


def top_percent_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return ranking.top_percent(o, "o_orderpriority", "o_totalprice", 5, "o_orderkey")


def seeded_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = manifest.seeded_split(F.col("o_orderkey"), {"train": 80, "valid": 10, "test": 10}, 13)
    return table(spark, sf_dir, "orders").groupBy(part.alias("part"), "o_orderstatus").agg(F.count("*").alias("n"))


def asof_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    right = e.where("event_id % 2 = 1").select("user_id", "ts", F.col("event_id").alias("source"), F.col("value").alias("level"))
    out = joins.asof_join(e.where("event_id % 2 = 0").select("event_id", "user_id", "ts"), right, "user_id", "ts", "source", ["source", "level"])
    return out.select("event_id", "asof_source", "asof_level")


def asof_all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As of the latest purchase, whoever made it: there is no key."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    right = e.where("event_type = 'purchase'").select("ts", F.col("event_id").alias("source"), F.col("value").alias("level"))
    return joins.asof_join(e.select("event_id", "ts"), right, None, "ts", "source", ["source", "level"]).select("event_id", "asof_source", "asof_level")


def running_all_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", F.round(F.col("value") * 100).alias("value"))
    return evaluation.running(e, None, ["ts", "event_id"], "value", 100).select("event_id", "running_best", "running_mean")


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.range(10).select((F.col("id") * 5.0 + 1).alias("lo"), (F.col("id") * 5.0 + 8).alias("hi"), F.col("id").alias("range_id"))
    out = joins.range_join(table(spark, sf_dir, "lineitem").select("l_quantity"), ranges, "l_quantity", 5.0)
    return out.groupBy("range_id").agg(F.count("*").alias("n"))


def half_open_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "lineitem").where(in_half_open(F.col("l_quantity"), F.lit(10.0), F.lit(20.0)) & ~F.col("l_returnflag").isin("R"))
    return part.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


def part_co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.co_occurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey").where("n > 1")


def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    out = metrics.pr_curve(li, F.col("l_quantity") / 50, F.col("l_returnflag") == "R", 2)
    return out.select("threshold", "tp", "fp", F.round("precision", 5).alias("precision"), F.round("recall", 5).alias("recall"))


def confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(table(spark, sf_dir, "lineitem"), F.col("l_returnflag"), (F.col("l_quantity") >= 25).cast("int"))


_KNN = r"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (
  SELECT a.vec_id AS query_id, b.vec_id AS id, a.label AS label, b.label AS hit,
         round(list_inner_product(a.v, b.v) / greatest(sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)), 1e-300), 9) AS sim
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), k AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) <= 10)
"""

QUERIES = {f.__name__: f for f in (knn_cosine, recall_by_label, vector_affinity, top_percent_per_group, seeded_split_counts, asof_events, asof_all_events, running_all_events, page_ranges, half_open_filter, part_co_occurrence, precision_recall, confusion_counts)} | attribution.QUERIES | selection.QUERIES | scoring.QUERIES | relations.QUERIES | files.QUERIES | pairs.QUERIES
ORACLES = {
    "knn_cosine": _KNN + "SELECT query_id, id, round(sim, 5) AS sim FROM k",
    "recall_by_label": _KNN + """, n AS (SELECT label, count(*) - 1 AS n FROM e GROUP BY label), p AS (SELECT query_id, label, count(*) FILTER (hit = label) AS f FROM k GROUP BY ALL)
SELECT p.label, CAST(sum(f) AS BIGINT) AS found, CAST(sum(least(n, 10)) AS BIGINT) AS total FROM p JOIN n ON p.label = n.label GROUP BY p.label""",
    "vector_affinity": "WITH e AS (SELECT vec_id, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS l FROM embeddings) SELECT vec_id, round(l, 5) AS length, round(exp(-pow(l, 2) / 8), 5) AS affinity FROM e",
    "top_percent_per_group": "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) <= ceil(count(*) OVER (PARTITION BY o_orderpriority) * 5.0::DOUBLE / 100)",
    "seeded_split_counts": "WITH o AS (SELECT o_orderstatus, ('0x' || substr(md5(concat('13:', o_orderkey)), 1, 8))::BIGINT % 100 AS p FROM orders) SELECT CASE WHEN p < 80 THEN 'train' WHEN p < 90 THEN 'valid' ELSE 'test' END AS part, o_orderstatus, count(*) AS n FROM o GROUP BY ALL",
    "asof_events": "SELECT l.event_id, (SELECT arg_max(r.event_id, (r.ts, r.event_id)) FROM events r WHERE r.event_id % 2 = 1 AND r.user_id = l.user_id AND r.ts <= l.ts) AS asof_source, (SELECT arg_max(r.value, (r.ts, r.event_id)) FROM events r WHERE r.event_id % 2 = 1 AND r.user_id = l.user_id AND r.ts <= l.ts) AS asof_level FROM events l WHERE l.event_id % 2 = 0",
    "asof_all_events": "WITH p AS (SELECT ts, arg_max(event_id, event_id) AS i, arg_max(value, event_id) AS v FROM events WHERE event_type = 'purchase' GROUP BY ts) SELECT e.event_id, p.i AS asof_source, p.v AS asof_level FROM events e ASOF LEFT JOIN p ON e.ts >= p.ts",
    "running_all_events": "WITH e AS (SELECT event_id, ts, round(value * 100) AS value FROM events) SELECT event_id, max(value) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS running_best, sum(value) OVER w / count(value) OVER w AS running_mean FROM e WINDOW w AS (ORDER BY ts, event_id ROWS 99 PRECEDING)",
    "page_ranges": "SELECT i AS range_id, count(*) AS n FROM lineitem JOIN range(10) t(i) ON l_quantity >= i * 5.0 + 1 AND l_quantity < i * 5.0 + 8 GROUP BY i",
    "half_open_filter": "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND l_returnflag <> 'R' GROUP BY l_returnflag",
    "part_co_occurrence": "WITH d AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS n FROM d x JOIN d y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY ALL HAVING count(*) > 1",
    "precision_recall": "WITH g AS (SELECT round(l_quantity / 50, 2) AS threshold, count(*) FILTER (l_returnflag = 'R') AS p, count(*) AS n FROM lineitem GROUP BY 1), c AS (SELECT threshold, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS s, sum(p) OVER () AS a FROM g WINDOW w AS (ORDER BY threshold DESC)) SELECT threshold, tp, s - tp AS fp, round(tp / s, 5) AS precision, round(tp / a, 5) AS recall FROM c",
    "confusion_counts": "SELECT l_returnflag AS label, CAST(l_quantity >= 25 AS INT) AS predicted, count(*) AS n FROM lineitem GROUP BY ALL",
} | attribution.ORACLES | selection.ORACLES | scoring.ORACLES | relations.ORACLES | files.ORACLES | pairs.ORACLES
