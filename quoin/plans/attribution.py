"""Queries on names, scored rows, shared-feature graphs and samples, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quoin.functions import names, vectors
from quoin.operators import evaluation, graphs, joins, ranking, statistics
from quoin.sources import sinks
from quoin.sources.tables import table

_R = "l_returnflag = 'R'"
_SCORE = "l_quantity / 50"


def name_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = F.expr("""concat('anon_R', o_custkey, '_iur_8_', element_at(array('gardenletters', 'notesontidesREDO', 'essay'), cast(o_orderkey % 3 + 1 AS int)), year(o_orderdate),
        if(o_orderkey % 5 = 0, 'A', ''), '-', lpad(cast(o_orderkey % 500 AS string), 4, '0'), if(o_orderkey % 11 = 0, concat('-', char(65 + o_orderkey % 26), '.jpg'),
        concat('_page1rline', o_custkey % 40, '_char', o_custkey % 7, '_', char(65 + o_orderkey % 26), '_uc.tif')))""")
    df = table(spark, sf_dir, "orders").select("o_orderkey", built.alias("name"))
    fields = {f.__name__: f(F.col("name")) for f in (names.printer, names.catalogue_id, names.year, names.book, names.book_without_redo, names.book_by_position, names.page, names.line, names.slot, names.letter)}
    return df.select("o_orderkey", *[v.alias(k) for k, v in fields.items()])


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = vectors.softmax(F.transform("embedding", lambda x: x.cast("double")))
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", p.alias("p"))
    return e.select("vec_id", "label", vectors.argmax(F.col("p")).alias("predicted"), F.round(F.array_max("p"), 6).alias("prob"))


def predicted_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir)


def confident_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir).where("label <> predicted").orderBy(F.col("prob").desc(), "vec_id").limit(20)


def price_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 20)


def score_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.survival(table(spark, sf_dir, "lineitem"), F.col("l_quantity"), [5.0 * i for i in range(10)])
    return out.select("threshold", F.round("share", 6).alias("share"))


def ranking_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.ranking_areas(table(spark, sf_dir, "lineitem"), F.expr(_SCORE), F.expr(_R))
    return out.select(F.round("auc", 6).alias("auc"), F.round("average_precision", 6).alias("average_precision"))


def best_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.best_f1(table(spark, sf_dir, "lineitem"), F.expr(_SCORE), F.expr(_R), 2).select("threshold", F.round("f1", 6).alias("f1"))


def macro_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.averages(table(spark, sf_dir, "lineitem"), "l_returnflag", F.col("l_quantity") > 25)
    return out.select(F.round("macro", 6).alias("macro"), F.round("micro", 6).alias("micro"))


def running_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    out = evaluation.running(e, "user_id", ["ts", "event_id"], "value", 10)
    return out.select("event_id", F.round("running_best", 4).alias("running_best"), F.round("running_mean", 7).alias("running_mean"))


def price_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(statistics.correlation("l_quantity", "l_extendedprice"), 6).alias("r"))


def mean_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("place", "x"))
    return e.groupBy("label", "place").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def match_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = graphs.ordered_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")
    return pairs.groupBy("l_partkey").agg(F.count("*").alias("partners"))


def shared_type_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.shared_edges(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", F.col("l_returnflag") == "A")


def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = joins.co_occurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey").where("n > 1")
    sizes = graphs.components(edges).groupBy("component").agg(F.count("*").alias("size"))
    return sizes.select("component", "size")


def degree_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = joins.co_occurrence(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey").where("n > 1")
    d = F.col("degree")
    return graphs.degrees(edges).agg(F.count("*").alias("nodes"), (F.sum(d) / 2).cast("long").alias("edges"), F.count_if(d >= 2).alias("at_least_2"), F.count_if(d >= 3).alias("at_least_3"), F.round(F.stddev_pop(d), 6).alias("spread"))


def set_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = lambda s: F.max(F.col("l_linestatus") == s)
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(has("O").alias("o"), has("F").alias("f"))
    return per.groupBy("l_suppkey").agg(F.count_if(F.col("o") & F.col("f")).alias("both"), F.count_if(F.col("o") & ~F.col("f")).alias("only_o"), F.count_if(F.col("f") & ~F.col("o")).alias("only_f"))


def group_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_partkey")), ",").alias("g"), F.count_distinct("l_partkey").alias("n"))
    return groups.groupBy("n").agg(F.count("*").alias("keys"), F.count_distinct("g").alias("different"))


def joined_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    per = s.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), " + ").alias("names"))
    return table(spark, sf_dir, "region").join(per, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("r_name", F.coalesce("names", F.lit("none")).alias("names"))


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.stratified_split(table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", "o_orderkey", 10, 42)
    return out.select("o_orderkey", "part")


def balanced_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.balanced(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "toxic", ["doc_id"])


def counterpart_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return ranking.pair_off(o.where("o_orderstatus = 'P'"), o.where("o_orderstatus = 'O'"), "o_orderpriority", "o_orderkey", 7)


def lookup_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = ranking.last_wins(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey")
    c = table(spark, sf_dir, "customer").select("c_custkey").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", F.coalesce("o_orderstatus", F.lit("unknown")).alias("status"))


def pattern_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ["#1", "#.*[135]$", "^Brand#[2-4]"]
    found = F.array_compact(F.array(*[F.when(F.col("p_brand").rlike(r), i) for i, r in enumerate(rules)]))
    return table(spark, sf_dir, "part").select(F.explode(found).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def wide_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("candidate"), F.col("o_totalprice").alias("score"))
    ranked = o.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "candidate")))
    return sinks.wide_rows(ranked, 5, 2).select(F.col("query").alias("o_custkey"), "row")


_PRED = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS p FROM embeddings), k AS (SELECT vec_id, label, CAST(list_position(p, list_max(p)) - 1 AS INT) AS predicted, round(1 / list_sum(list_transform(p, lambda x: exp(x - list_max(p)))), 6) AS prob FROM e)"
_PAIRS = "WITH RECURSIVE d AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), e AS (SELECT x.p AS a, y.p AS b FROM d x JOIN d y ON x.o = y.o AND x.p < y.p GROUP BY ALL HAVING count(*) > 1), s AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e)"
_COUNTS = "WITH c AS (SELECT l_quantity / 50 AS s, count(*) FILTER (l_returnflag = 'R') AS p, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM c WINDOW w AS (ORDER BY s DESC))"

QUERIES = {f.__name__: f for f in (name_fields, predicted_class, confident_errors, price_histogram, score_survival, ranking_areas, best_f1, macro_micro, running_metrics, price_correlation, mean_template, match_partners, shared_type_edges, component_sizes, degree_stats, set_relations, group_tally, joined_names, stratified_split, balanced_labels, counterpart_pairs, lookup_with_default, pattern_matches, wide_top)}
ORACLES = {
    "name_fields": """SELECT o_orderkey, 'anon' AS printer, concat('R', o_custkey) AS catalogue_id, CASE WHEN o_orderkey % 5 = 0 THEN try_cast(concat(right(CAST(year(o_orderdate) AS VARCHAR), 3), 'A') AS INT) ELSE CAST(year(o_orderdate) AS INT) END AS year,
concat(b, year(o_orderdate)) AS book, concat(replace(b, 'REDO', ''), year(o_orderdate)) AS book_without_redo, CASE WHEN o_orderkey % 11 = 0 THEN 'None' ELSE concat(b, year(o_orderdate), CASE WHEN o_orderkey % 5 = 0 THEN 'A' ELSE '' END) END AS book_by_position,
CAST(o_orderkey % 500 AS INT) AS page, CAST(CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE o_custkey % 40 END AS INT) AS line, CAST(CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE o_custkey % 7 END AS INT) AS slot, CASE WHEN o_orderkey % 11 <> 0 THEN chr(CAST(65 + o_orderkey % 26 AS INT)) END AS letter
FROM (SELECT *, ['gardenletters', 'notesontidesREDO', 'essay'][o_orderkey % 3 + 1] AS b FROM orders)""",
    "predicted_class": _PRED + " SELECT * FROM k",
    "confident_errors": _PRED + " SELECT * FROM k WHERE label <> predicted ORDER BY prob DESC, vec_id LIMIT 20",
    "price_histogram": "WITH m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem) SELECT CAST(least(floor((l_extendedprice - lo) / (hi - lo) * 20), 19) AS BIGINT) AS bin, count(*) AS n FROM lineitem, m GROUP BY 1",
    "score_survival": "SELECT CAST(t AS DOUBLE) AS threshold, round(avg(CASE WHEN l_quantity > t THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM lineitem, (SELECT unnest(range(0, 50, 5)) AS t) GROUP BY t",
    "ranking_areas": _COUNTS + " SELECT round(sum((n - p) * (tp - p / 2)) / (sum(p) * sum(n - p)), 6) AS auc, round(sum(p * tp / seen) / sum(p), 6) AS average_precision FROM t",
    "best_f1": "WITH c AS (SELECT round(l_quantity / 50, 2) AS s, count(*) FILTER (l_returnflag = 'R') AS p, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT s, round(2.0::DOUBLE * sum(p) OVER w / (sum(n) OVER w + sum(p) OVER ()), 9) AS f FROM c WINDOW w AS (ORDER BY s DESC)) SELECT s AS threshold, round(f, 6) AS f1 FROM t ORDER BY f DESC, s LIMIT 1",
    "macro_micro": "WITH g AS (SELECT count(*) FILTER (l_quantity > 25) AS f, count(*) AS n FROM lineitem GROUP BY l_returnflag) SELECT round(avg(f / n), 6) AS macro, round(sum(f) / sum(n), 6) AS micro FROM g",
    "running_metrics": "SELECT event_id, round(max(value) OVER (w ROWS UNBOUNDED PRECEDING), 4) AS running_best, round(avg(value) OVER (w ROWS 9 PRECEDING), 7) AS running_mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "price_correlation": "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1",
    "mean_template": "SELECT label, CAST(place - 1 AS INT) AS place, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS place FROM embeddings) GROUP BY ALL",
    "match_partners": "SELECT x.l_partkey, count(DISTINCT y.l_partkey) AS partners FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_partkey <> y.l_partkey GROUP BY 1",
    "shared_type_edges": "WITH o AS (SELECT l_suppkey AS s, l_partkey AS p, bool_or(l_returnflag = 'A') AS h FROM lineitem GROUP BY ALL) SELECT x.s AS a, y.s AS b, count(*) AS n, count(*) FILTER (x.h AND y.h) AS n_strong, bool_or(x.h OR y.h) AS any_strong FROM o x JOIN o y ON x.p = y.p AND x.s < y.s GROUP BY x.s, y.s",
    "component_sizes": _PAIRS + ", r(n, m) AS (SELECT a, a FROM s UNION SELECT r.n, s.b FROM r JOIN s ON r.m = s.a), c AS (SELECT n, min(m) AS component FROM r GROUP BY n) SELECT component, count(*) AS size FROM c GROUP BY component",
    "degree_stats": _PAIRS + ", g AS (SELECT a, count(*) AS d FROM s GROUP BY a) SELECT count(*) AS nodes, CAST(sum(d) / 2 AS BIGINT) AS edges, count(*) FILTER (d >= 2) AS at_least_2, count(*) FILTER (d >= 3) AS at_least_3, round(stddev_pop(d), 6) AS spread FROM g",
    "set_relations": "WITH p AS (SELECT l_suppkey, l_partkey, bool_or(l_linestatus = 'O') AS o, bool_or(l_linestatus = 'F') AS f FROM lineitem GROUP BY ALL) SELECT l_suppkey, count(*) FILTER (o AND f) AS both, count(*) FILTER (o AND NOT f) AS only_o, count(*) FILTER (f AND NOT o) AS only_f FROM p GROUP BY 1",
    "group_tally": "WITH g AS (SELECT l_orderkey, list_sort(list(DISTINCT l_partkey)) AS g FROM lineitem GROUP BY 1) SELECT CAST(len(g) AS BIGINT) AS n, count(*) AS keys, count(DISTINCT g) AS different FROM g GROUP BY 1",
    "joined_names": "SELECT r_name, coalesce(string_agg(DISTINCT n_name, ' + ' ORDER BY n_name), 'none') AS names FROM region LEFT JOIN (SELECT n_regionkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)) ON r_regionkey = n_regionkey GROUP BY r_name",
    "stratified_split": "SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(concat('42:', o_orderkey)), o_orderkey) * 100 <= count(*) OVER (PARTITION BY o_orderpriority) * 10 THEN 'test' ELSE 'train' END AS part FROM orders",
    "balanced_labels": "SELECT doc_id, toxic FROM labels QUALIFY row_number() OVER (PARTITION BY toxic ORDER BY doc_id) <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic))",
    "counterpart_pairs": "WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY md5(concat('7:', o_orderkey)), o_orderkey) AS n FROM orders) SELECT x.o_orderpriority, x.o_orderkey AS a, y.o_orderkey AS b FROM o x JOIN o y ON x.o_orderpriority = y.o_orderpriority AND x.n = y.n AND x.o_orderstatus = 'P' AND y.o_orderstatus = 'O'",
    "lookup_with_default": "SELECT c_custkey, coalesce((SELECT arg_max(o_orderstatus, o_orderkey) FROM orders WHERE o_custkey = c_custkey), 'unknown') AS status FROM customer",
    "pattern_matches": "SELECT CAST(i AS INT) AS rule, count(*) AS n FROM part JOIN (VALUES (0, '#1'), (1, '#.*[135]$'), (2, '^Brand#[2-4]')) r(i, q) ON regexp_matches(p_brand, q) GROUP BY i",
    "wide_top": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) SELECT o_custkey, concat(o_custkey, '|', string_agg(CAST(o_orderkey AS VARCHAR), '|' ORDER BY n), '|', string_agg(printf('%.2f', o_totalprice), '|' ORDER BY n)) AS row FROM r WHERE n <= 5 GROUP BY 1",
}
