"""Queries on retrieval, scored rows and statistics, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quoin.functions import vectors
from quoin.operators import evaluation, metrics, ranking, retrieval, statistics
from quoin.sources.storage import shared_path, written
from quoin.sources.tables import table

_SCORE, _R = "l_extendedprice", "l_returnflag = 'R'"


def _embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumn("book", F.col("vec_id") % 7)


def _hits(spark: SparkSession, sf_dir: str, k: int) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    labels = e.select(F.col("vec_id").alias("id"), F.col("label").alias("hit"))
    sizes = e.groupBy("label").agg((F.count("*") - 1).alias("n"))
    truth = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label").join(sizes, "label").withColumnRenamed("label", "group")
    hits = retrieval.knn(e.where("vec_id % 20 = 0"), e, k).join(labels, "id").join(truth.select("query_id", "group"), "query_id")
    return hits.select("query_id", "rank", "sim", (F.col("hit") == F.col("group")).alias("relevant")), truth


def recall_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = evaluation.recall_grid(*_hits(spark, sf_dir, 50), [1, 3, 5, 10, 50])
    return grid.select(F.col("group").alias("label"), "k", "found", "total", F.round("recall", 6).alias("recall"))


def macro_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.macro_recall(evaluation.recall_grid(*_hits(spark, sf_dir, 10), [1, 3, 5, 10]))
    return out.select("k", F.round("macro", 6).alias("macro"), F.round("micro", 6).alias("micro"))


def hit_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.hit_positions(_hits(spark, sf_dir, 10)[0]).select("query_id", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


def similarity_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.similarity_spread(_hits(spark, sf_dir, 10)[0], 5)
    return out.select(*[F.round(c, 5).alias(c) for c in out.columns])


def filtered_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    out = retrieval.discover(e.where("vec_id % 20 = 0"), e.where(F.col("vec_id").between(10, 100000)), 5, "label", least=0.1, differ=("book",))
    return out.select("query_id", "id", F.round("sim", 5).alias("sim"), "rank")


def nearest_with_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir).select("vec_id", "embedding")
    out = retrieval.discover(e.where("vec_id % 20 = 0"), e, 11, None, metric="l2", with_self=True)
    return out.select("query_id", "id", F.round(-F.col("sim"), 5).alias("distance"))


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir).select("vec_id", "label", "embedding")
    q = e.where("vec_id % 20 = 0")
    first = written(retrieval.discover(q, e, 20, "label"), "first")
    return retrieval.reranked(first, retrieval.scored_again(first, q, e, "l2"), 5).select("query_id", "id", F.round("sim", 5).alias("sim"))


def all_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir).select("vec_id", "embedding")
    return retrieval.knn(e, e, 5).select("query_id", "id", F.round("sim", 5).alias("sim"), "rank")


def cell_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a written index finds nine in ten of the exact neighbours when a quarter of its cells is probed."""
    e = _embeddings(spark, sf_dir).select("vec_id", "embedding")
    index = retrieval.CellIndex.write(e, shared_path(spark, "cells"), 64, copies=3)
    queries = e.where("vec_id % 20 = 0")
    exact = retrieval.knn(queries, e, 10).select("query_id", "id")
    found = index.search(queries, 10, 16).select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(found, ["query_id", "id"], "left").agg(F.count("*").alias("wanted"), (F.count("hit") >= 0.9 * F.count("*")).alias("nine_in_ten"))


def kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _embeddings(spark, sf_dir)
    a, b = e.select("vec_id", "embedding"), e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    x, y = F.col("embedding"), F.col("next")
    out = a.join(b, "vec_id").select(
        "vec_id", vectors.product(x, y).alias("product"), vectors.squared_distance(x, y).alias("squared"), vectors.distance(x, y).alias("distance"), vectors.exponential_kernel(x, y, 2.0).alias("exponential"),
        vectors.rational_kernel(x, y, 2.0, 0.5).alias("rational"), vectors.polynomial_kernel(x, y).alias("polynomial"), vectors.sigmoid(vectors.product(x, y)).alias("sigmoid"), F.get(vectors.unit(F.transform(x, lambda v: v * 3)), 0).alias("unit"),
    )
    return out.select("vec_id", *[F.round(c, 5).alias(c) for c in out.columns[1:]])


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.col("c_custkey") % 1000
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(vectors.warmup_cosine(step, 100, 900, 0.1, 0.01), 6).alias("rate"))


def price_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.pr_curve(table(spark, sf_dir, "lineitem"), F.col(_SCORE), F.expr(_R))
    return out.select("threshold", "tp", "fp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def error_tradeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.error_tradeoff(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.expr(_R))
    return out.select("threshold", F.round("false_positive_rate", 6).alias("fpr"), F.round("false_negative_rate", 6).alias("fnr"))


def threshold_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.at_threshold(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.expr(_R), 25.0)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def best_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.best_accuracy(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), F.expr(_R), [5.0, 10.0, 20.0, 40.0, 45.0])
    return out.select("threshold", F.round("accuracy", 6).alias("accuracy"))


def precision_at_recalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.precision_at_recalls(table(spark, sf_dir, "lineitem"), F.col(_SCORE), F.expr(_R), [0.1, 0.25, 0.5, 0.9, 1.0])
    return out.select("target", F.round("precision", 6).alias("precision"))


def interpolated_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.interpolated_precision(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), F.expr(_R), [0.05, 0.25, 0.5, 0.9, 0.95, 0.99])
    return out.select("target", F.round("threshold", 2).alias("threshold"), *[F.round(c, 6).alias(c) for c in ("precision", "recall", "best")])


def confusion_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.confusion(table(spark, sf_dir, "lineitem"), F.col("l_returnflag"), F.col("l_linestatus"), shares=True)
    return out.withColumn("share", F.round("share", 6))


def price_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.summary(table(spark, sf_dir, "lineitem"), F.col("l_extendedprice"), ["l_returnflag"])
    return out.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "std", "min", "max")])


def scaled_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.inverted(statistics.scaled(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice"), "p_retailprice")
    return out.select("p_partkey", F.round("scaled", 6).alias("scaled"), F.round("affinity", 6).alias("affinity"))


def partial_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.partial_correlation(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return out.select("a", "b", F.round("r", 6).alias("r"))


def shared_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    gap = statistics.information_gap(df, "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount"])
    mi = statistics.mutual_information(df, "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount"])
    # one row
    return mi.join(F.broadcast(gap)).select("value", F.round("mi", 7).alias("mi"), F.round("gap", 7).alias("gap"))


def kernel_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = lambda n, m: table(spark, sf_dir, "embeddings").where(F.col("vec_id") % 4 == m).select((F.col("vec_id") - m).alias("at"), F.col("embedding").alias(n))
    pairs = side("x1", 0).join(side("x2", 1), "at").join(side("y1", 2), "at").join(side("y2", 3), "at")
    return statistics.linear_mmd(pairs, vectors.exponential_kernel).select(F.round("mmd2", 7).alias("mmd2"), F.round("z", 5).alias("z"))


def best_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.round("value", 2).alias("value"))
    best = F.max_by("event_id", F.struct("value", -F.col("event_id")))
    return e.groupBy("user_id").agg(best.alias("epoch"), F.max("value").alias("value"))


def majority_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    return counts.groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("n", "o_orderstatus")).alias("status"))


def limited_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ranking.ranked_by_seed(table(spark, sf_dir, "embeddings"), ["label"], "vec_id", 2).where("rank <= 20")
    mean = e.select("label", F.posexplode("embedding").alias("place", "x")).groupBy("label", "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    centre = mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "x"))), lambda s: s["x"]).alias("mean"))
    return e.join(centre, "label").select("vec_id", "label", F.round(vectors.distance(F.col("embedding"), F.col("mean")), 5).alias("distance"))


def template_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.by_distance_from_mean(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return out.select("vec_id", "label", F.round("distance", 5).alias("distance"), "rank")


_HITS = """
WITH e AS (SELECT vec_id, label, vec_id % 7 AS book, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (
  SELECT a.vec_id AS query_id, b.vec_id AS id, a.label, b.label AS hit, a.book AS qbook, b.book, list_sum(list_transform(list_zip(a.v, b.v), lambda z: pow(z[1] - z[2], 2))) AS d,
         round(list_inner_product(a.v, b.v) / greatest(sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v)), 1e-300), 9) AS sim
  FROM e a JOIN e b ON a.vec_id % 20 = 0
), h AS (SELECT *, label = hit AS relevant, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM q WHERE query_id <> id),
n AS (SELECT label, count(*) - 1 AS n FROM e GROUP BY label),
g AS (SELECT h.label, k, query_id, count(*) FILTER (relevant AND rank <= k) AS found, min(least(n, k)) AS total FROM h JOIN n ON h.label = n.label, (SELECT unnest([1, 3, 5, 10, 50]) AS k) GROUP BY h.label, k, query_id),
r AS (SELECT label, CAST(k AS INT) AS k, CAST(sum(found) AS BIGINT) AS found, CAST(sum(total) AS BIGINT) AS total, coalesce(sum(found) / nullif(sum(total), 0), 0) AS recall FROM g GROUP BY ALL)
"""
_CURVE = "WITH c AS (SELECT {s} AS s, count(*) FILTER (l_returnflag = 'R') AS p, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT s, sum(p) OVER w AS tp, sum(n) OVER w AS seen, sum(p) OVER () AS pos, sum(n) OVER () AS every FROM c WINDOW w AS (ORDER BY s DESC))"
_MI = " UNION ALL ".join(f"SELECT '{v}' AS value, l_returnflag AS f, least(floor(({v} - lo) / (hi - lo) * 20), 19) AS b FROM lineitem, (SELECT min({v}) AS lo, max({v}) AS hi FROM lineitem)" for v in ("l_quantity", "l_extendedprice", "l_discount"))
_CORR = "(SELECT corr({a}, {b}) FROM lineitem)"
_K = "exp(-list_sum(list_transform(list_zip({a}, {b}), lambda z: pow(z[1] - z[2], 2))) / 2)"

QUERIES = {f.__name__: f for f in (recall_grid, macro_recall, hit_positions, similarity_spread, filtered_neighbours, nearest_with_self, reranked, all_neighbours, cell_recall, kernels, rates, price_curve, error_tradeoff, threshold_scores, best_accuracy, precision_at_recalls, interpolated_precision, confusion_shares, price_summary, scaled_prices, partial_correlations, shared_information, kernel_test, best_epochs, majority_status, limited_template, template_ranks)}
ORACLES = {
    "recall_grid": _HITS + "SELECT label, k, found, total, round(recall, 6) AS recall FROM r",
    "macro_recall": _HITS + "SELECT k, round(avg(recall), 6) AS macro, round(sum(found) / sum(total), 6) AS micro FROM r WHERE k <= 10 GROUP BY k",
    "hit_positions": _HITS + "SELECT query_id, coalesce(string_agg(CAST(rank - 1 AS VARCHAR), ',' ORDER BY rank) FILTER (relevant), '') AS positions FROM h WHERE rank <= 10 GROUP BY query_id",
    "similarity_spread": _HITS + ", p AS (SELECT query_id, min(sim) AS lo, max(sim) AS hi FROM h WHERE rank <= 5 GROUP BY 1) SELECT round(avg(lo), 5) AS min_sim, round(avg(hi), 5) AS max_sim, round(avg(hi - lo), 5) AS range, round(avg(1 - hi), 5) AS min_distance, round(avg(1 - lo), 5) AS max_distance FROM p",
    "filtered_neighbours": _HITS + ", f AS (SELECT query_id, id, sim, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS INT) AS rank FROM q WHERE label = hit AND query_id <> id AND qbook <> book AND id BETWEEN 10 AND 100000 AND sim >= 0.1) SELECT query_id, id, round(sim, 5) AS sim, rank FROM f WHERE rank <= 5",
    "nearest_with_self": _HITS + "SELECT query_id, id, abs(round(d, 5)) AS distance FROM q QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) <= 11",
    "reranked": _HITS + ", f AS (SELECT * FROM h WHERE relevant QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) <= 20) SELECT query_id, id, round(sim - round(d, 9), 5) AS sim FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim - round(d, 9) DESC, id) <= 5",
    "all_neighbours": _HITS.replace("e a JOIN e b ON a.vec_id % 20 = 0", "e a JOIN e b ON true") + "SELECT query_id, id, round(sim, 5) AS sim, CAST(rank AS INT) AS rank FROM h WHERE rank <= 5",
    "cell_recall": _HITS + "SELECT count(*) AS wanted, true AS nine_in_ten FROM h WHERE rank <= 10",
    "kernels": "WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.vec_id, a.v[1] / sqrt(list_inner_product(a.v, a.v)) AS u, list_inner_product(a.v, b.v) AS p, list_sum(list_transform(list_zip(a.v, b.v), lambda z: pow(z[1] - z[2], 2))) AS d FROM e a JOIN e b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(p, 5) AS product, round(d, 5) AS squared, round(sqrt(d), 5) AS distance, round(exp(-d / 8), 5) AS exponential, round(pow(1 + d / 4, -0.5), 5) AS rational, round(pow(p + 1, 2), 5) AS polynomial, round(1 / (1 + exp(-p)), 5) AS sigmoid, round(u, 5) AS unit FROM p",
    "rates": "SELECT c_custkey, round(CASE WHEN c_custkey % 1000 < 100 THEN 0.1::DOUBLE * (c_custkey % 1000) / 100 ELSE 0.01::DOUBLE + 0.045::DOUBLE * (1 + cos(least(1, (c_custkey % 1000 - 100) / 800.0::DOUBLE) * pi())) END, 6) AS rate FROM customer",
    "price_curve": _CURVE.format(s=_SCORE) + " SELECT s AS threshold, CAST(tp AS BIGINT) AS tp, CAST(seen - tp AS BIGINT) AS fp, round(tp / seen, 6) AS precision, round(tp / pos, 6) AS recall FROM t",
    "error_tradeoff": _CURVE.format(s="l_quantity") + " SELECT s AS threshold, round((seen - tp) / (every - pos), 6) AS fpr, round((pos - tp) / pos, 6) AS fnr FROM t",
    "threshold_scores": "WITH c AS (SELECT count(*) FILTER (l_quantity > 25) AS c, count(*) FILTER (l_quantity > 25 AND l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'R') AS p FROM lineitem) SELECT round(r / c, 6) AS precision, round(r / p, 6) AS recall, round(2 * r / (c + p), 6) AS f1 FROM c",
    "best_accuracy": "WITH t AS (SELECT unnest([5.0, 10, 20, 40, 45]) AS t UNION ALL SELECT median(l_quantity) FROM lineitem) SELECT CAST(t AS DOUBLE) AS threshold, round(avg(CASE WHEN (l_quantity > t) = (l_returnflag = 'R') THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy FROM lineitem, t GROUP BY t ORDER BY accuracy DESC, t LIMIT 1",
    "precision_at_recalls": _CURVE.format(s=_SCORE) + " SELECT CAST(g AS DOUBLE) AS target, round(max(tp / seen) FILTER (tp / pos >= g), 6) AS precision FROM t, (SELECT unnest([0.1::DOUBLE, 0.25, 0.5, 0.9, 1.0]) AS g) GROUP BY g",
    "interpolated_precision": _CURVE.format(s=_SCORE) + ", u AS (SELECT s, tp / seen AS p, tp / pos AS r FROM t) SELECT CAST(g AS DOUBLE) AS target, round(max(s) FILTER (r > g + 0.01::DOUBLE), 2) AS threshold, round(coalesce(arg_min(p, s) FILTER (r <= g + 0.01::DOUBLE), 1), 6) AS precision, round(coalesce(arg_min(r, s) FILTER (r <= g + 0.01::DOUBLE), 0), 6) AS recall, round(max(p) FILTER (r > g + 0.01::DOUBLE), 6) AS best FROM u, (SELECT unnest([0.05::DOUBLE, 0.25, 0.5, 0.9, 0.95, 0.99]) AS g) GROUP BY g",
    "confusion_shares": "WITH c AS (SELECT l_returnflag AS label, l_linestatus AS predicted, count(*) AS n FROM lineitem GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM c",
    "price_summary": "SELECT l_returnflag, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(median(l_extendedprice), 4) AS median, round(stddev_pop(l_extendedprice), 4) AS std, round(min(l_extendedprice), 4) AS min, round(max(l_extendedprice), 4) AS max FROM lineitem GROUP BY 1",
    "scaled_prices": "SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS scaled, round(max(p_retailprice) OVER () - p_retailprice, 6) AS affinity FROM part",
    "partial_correlations": "WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS qe, corr(l_quantity, l_discount) AS qd, corr(l_extendedprice, l_discount) AS ed FROM lineitem) SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round((qe - qd * ed) / sqrt((1 - qd * qd) * (1 - ed * ed)), 6) AS r FROM c UNION ALL SELECT 'l_quantity', 'l_discount', round((qd - qe * ed) / sqrt((1 - qe * qe) * (1 - ed * ed)), 6) FROM c UNION ALL SELECT 'l_extendedprice', 'l_discount', round((ed - qe * qd) / sqrt((1 - qe * qe) * (1 - qd * qd)), 6) FROM c",
    "shared_information": f"WITH x AS ({_MI}), n AS (SELECT value, f, b, count(*) AS n FROM x GROUP BY ALL), p AS (SELECT *, sum(n) OVER (PARTITION BY value, f) AS nf, sum(n) OVER (PARTITION BY value, b) AS nb, sum(n) OVER (PARTITION BY value) AS t FROM n), m AS (SELECT value, sum(n / t * ln(n * t / (nf * nb))) AS mi FROM p GROUP BY value), h AS (SELECT -sum(n / t * ln(n / t)) AS h FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM lineitem GROUP BY l_returnflag)) SELECT value, round(mi, 7) AS mi, round(((SELECT max(mi) FROM m) - (SELECT list_sort(list(mi), 'DESC')[2] FROM m)) / h, 7) AS gap FROM m, h",
    "kernel_test": f"WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT a.v AS a, b.v AS b, c.v AS c, d.v AS d FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 JOIN e c ON c.vec_id = a.vec_id + 2 JOIN e d ON d.vec_id = a.vec_id + 3 WHERE a.vec_id % 4 = 0), h AS (SELECT {_K.format(a='a', b='b')} + {_K.format(a='c', b='d')} - {_K.format(a='a', b='d')} - {_K.format(a='b', b='c')} AS h FROM p) SELECT round(avg(h), 7) AS mmd2, round(avg(h) / sqrt(var_samp(h) / count(*)), 5) AS z FROM h",
    "best_epochs": "SELECT user_id, arg_max(event_id, (round(value, 2), -event_id)) AS epoch, max(round(value, 2)) AS value FROM events GROUP BY user_id",
    "majority_status": "SELECT o_custkey, arg_max(o_orderstatus, (n, o_orderstatus)) AS status FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) GROUP BY o_custkey",
    "template_ranks": "WITH x AS (SELECT vec_id, label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL), d AS (SELECT vec_id, label, sqrt(sum(pow(x - m, 2))) AS d FROM x JOIN m USING (label, i) GROUP BY ALL) SELECT vec_id, label, round(d, 5) AS distance, row_number() OVER (PARTITION BY label ORDER BY round(d, 9), vec_id) AS rank FROM d",
    "limited_template": "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(concat('2:', vec_id)), vec_id) <= 20), x AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL) SELECT vec_id, label, round(sqrt(sum(pow(x - m, 2))), 5) AS distance FROM x JOIN m USING (label, i) GROUP BY ALL",
}
