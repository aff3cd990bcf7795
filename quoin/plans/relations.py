"""Queries on graphs, pairings and matrices, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quoin.operators import graphs, joins
from quoin.sources.storage import written
from quoin.sources.tables import table


def edge_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    out = graphs.shared_edges(li, "l_suppkey", "l_partkey", F.col("l_returnflag") == "A", F.col("l_returnflag") == "N", "l_returnflag")
    grades = F.array_join(F.transform(F.map_entries("grades"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return out.select("a", "b", "n", "n_strong", "n_not_weak", "any_strong", F.array_join(F.transform("sample", lambda x: x.cast("string")), ",").alias("sample"), grades.alias("grades"))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that hold lines of one supplier, day and quantity: few enough to leave many clusters."""
    page = F.concat_ws("/", "l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd"), "l_quantity")
    return table(spark, sf_dir, "lineitem").select(page.alias("page"), "l_orderkey")


def part_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.clusters(_pages(spark, sf_dir), "page", "l_orderkey")


def seeded_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "P", F.col("o_custkey")).alias("seed"))
    return graphs.clusters(_pages(spark, sf_dir), "page", "l_orderkey", seeds)


def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.size_histogram(graphs.components_of_groups(_pages(spark, sf_dir), "page", "l_orderkey"))


def _weighted(spark: SparkSession, sf_dir: str, again: bool = True) -> DataFrame:
    """Suppliers by the parts they share; again: written once, for queries that read them several times."""
    found = joins.co_occurrence(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey").withColumnRenamed("n", "weight")
    return written(found, "edges") if again else found


def filtered_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges one spread above the mean weight, without the nodes that have more than 1.1 times the mean degree by them."""
    weighted = _weighted(spark, sf_dir)
    stats = graphs.weight_stats(weighted).first()
    least = stats.mean + stats.spread
    strong = graphs.degrees(weighted.where(F.col("weight") >= least)).agg(F.avg("degree")).first()[0] or 0
    return graphs.filter_graph(weighted, least, int(1.1 * strong))


def edge_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graphs.weight_stats(_weighted(spark, sf_dir, again=False))
    return out.select("edges", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"))


def within_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").alias("label"))
    return graphs.symmetric(graphs.within(_weighted(spark, sf_dir), labels))


def laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.shared_laplacian(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey").select("a", "b", F.round("value", 7).alias("value"))


def status_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.lower_triangle(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


def last_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graphs.last_group_pairs(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey")
    return out.select("l_partkey", F.array_join(F.transform("others", lambda x: x.cast("string")), ",").alias("others"))


def twin_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 2).alias("pair"), "c_custkey").where("c_custkey % 10 <> 3")
    return joins.twins(c, "pair", "c_custkey")


def partners_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.other_group_partner(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey", 9)


def interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place"), F.col("c_name").alias("name")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place"), F.col("s_name").alias("name"))
    choice = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place"), (F.col("s_suppkey") % 3 % 2).cast("int").alias("side"))
    return joins.interleave([c, s], choice, "place", "side")


def other_printers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    joined = li.groupBy("l_partkey").agg(F.array_join(F.sort_array(F.collect_set("n_name")), " + ").alias("names"))
    return joined.select(F.explode(F.split("names", r" \+ ")).alias("name")).groupBy("name").agg(F.count("*").alias("parts"))


def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    mine = li.where("l_suppkey = 7").select("l_orderkey", "l_partkey")
    others = li.where("l_suppkey <> 7").select("l_partkey", "l_suppkey").distinct().join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return mine.join(others, "l_partkey").groupBy("s_nationkey").agg(F.count_distinct("l_orderkey").alias("issues"), F.count_distinct("l_partkey").alias("letters"), F.count_distinct("s_suppkey").alias("books"))


def page_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber").distinct()
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_suppkey", "l_linenumber"))), lambda p: F.concat(p["l_suppkey"].cast("string"), F.lit(":"), p["l_linenumber"].cast("string"))), ", ")
    return pairs.groupBy("l_partkey").agg(text.alias("breakdown"))


_PAGES = "SELECT concat_ws('/', l_suppkey, strftime(l_shipdate, '%Y-%m-%d'), l_quantity) AS g, l_orderkey AS i FROM lineitem"
_REACH = """, n AS (SELECT DISTINCT i FROM s0), l AS (SELECT DISTINCT x.i AS a, y.i AS b FROM s0 x JOIN s0 y ON x.g = y.g), r(a, b) AS (SELECT i, i FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a), c AS (SELECT a AS i, min(b) AS component FROM r GROUP BY a)"""
_NAMED = _REACH + ", z AS (SELECT *, count(*) OVER (PARTITION BY component) AS size FROM c), m AS (SELECT component, CAST(row_number() OVER (ORDER BY component) AS VARCHAR) AS k FROM (SELECT DISTINCT component FROM z WHERE size > 1)) SELECT i AS l_orderkey, coalesce(k, 'Isolated') AS cluster FROM z LEFT JOIN m USING (component)"
_WEIGHTED = "WITH d AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem), w AS (SELECT x.s AS a, y.s AS b, count(*) AS weight FROM d x JOIN d y ON x.p = y.p AND x.s < y.s GROUP BY ALL)"

QUERIES = {f.__name__: f for f in (edge_support, part_clusters, seeded_clusters, cluster_sizes, filtered_graph, edge_weights, within_nations, laplacian, status_triangle, last_groups, twin_pairs, partners_elsewhere, interleaved, other_printers, cross_references, page_breakdown)}
ORACLES = {
    "edge_support": """WITH li AS (SELECT l_suppkey AS s, l_partkey AS p, l_returnflag AS f FROM lineitem), o AS (SELECT s, p, bool_or(f = 'A') AS h, bool_or(f = 'N') AS w FROM li GROUP BY ALL), e AS (SELECT x.s AS a, y.s AS b, x.p, x.h AS hx, y.h AS hy, x.w AS wx, y.w AS wy FROM o x JOIN o y ON x.p = y.p AND x.s < y.s),
g AS (SELECT a, b, f, count(*) AS c FROM e JOIN li ON li.p = e.p AND (li.s = a OR li.s = b) GROUP BY ALL), t AS (SELECT a, b, string_agg(concat(f, ':', c), ',' ORDER BY f) AS grades FROM g GROUP BY ALL)
SELECT a, b, count(*) AS n, count(*) FILTER (hx AND hy) AS n_strong, count(*) FILTER (NOT wx AND NOT wy) AS n_not_weak, bool_or(hx OR hy) AS any_strong, array_to_string(list_sort(list(p))[1:5], ',') AS sample, any_value(grades) AS grades FROM e JOIN t USING (a, b) GROUP BY a, b""",
    "part_clusters": f"WITH RECURSIVE s0 AS ({_PAGES})" + _NAMED,
    "seeded_clusters": f"WITH RECURSIVE s0 AS (SELECT concat('group ', g) AS g, i FROM ({_PAGES}) UNION ALL SELECT concat('seed ', o_custkey), o_orderkey FROM orders WHERE o_orderstatus = 'P')" + _NAMED,
    "cluster_sizes": f"WITH RECURSIVE s0 AS ({_PAGES})" + _REACH + ", z AS (SELECT component, count(*) AS size FROM c GROUP BY 1) SELECT size, count(*) AS n FROM z WHERE size > 1 GROUP BY size",
    "filtered_graph": _WEIGHTED + ", e AS (SELECT * FROM w WHERE weight >= (SELECT avg(weight) + stddev_samp(weight) FROM w)), h AS (SELECT n, count(*) AS d FROM (SELECT a AS n FROM e UNION ALL SELECT b FROM e) GROUP BY n), g AS (SELECT n FROM h WHERE d <= (SELECT floor(1.1::DOUBLE * avg(d)) FROM h)) SELECT a, b, weight FROM e WHERE a IN (SELECT n FROM g) AND b IN (SELECT n FROM g)",
    "edge_weights": _WEIGHTED + " SELECT count(*) AS edges, round(avg(weight), 6) AS mean, round(stddev_samp(weight), 6) AS spread FROM w",
    "within_nations": _WEIGHTED + ", e AS (SELECT a, b, weight FROM w JOIN supplier x ON a = x.s_suppkey JOIN supplier y ON b = y.s_suppkey WHERE x.s_nationkey = y.s_nationkey) SELECT a, b, weight FROM e UNION ALL SELECT b, a, weight FROM e",
    "laplacian": _WEIGHTED + ", e AS (SELECT a, b, weight FROM w UNION ALL SELECT b, a, weight FROM w), t AS (SELECT a, sum(weight) AS d FROM e GROUP BY a) SELECT e.a, e.b, round(-weight / sqrt(CAST(x.d AS DOUBLE) * y.d), 7) AS value FROM e JOIN t x ON e.a = x.a JOIN t y ON e.b = y.a UNION ALL SELECT a, a, 1.0::DOUBLE FROM t",
    "status_triangle": "WITH o AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem), i AS (SELECT DISTINCT s FROM o), m AS (SELECT u.s AS a, v.s AS b, count(*) AS n FROM o u JOIN o v ON u.p = v.p AND u.s >= v.s GROUP BY ALL) SELECT x.s AS a, y.s AS b, coalesce(n, 0) AS n FROM i x JOIN i y ON x.s >= y.s LEFT JOIN m ON m.a = x.s AND m.b = y.s",
    "last_groups": "WITH g AS (SELECT l_orderkey AS o, list_sort(list(DISTINCT l_partkey)) AS l FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 2), x AS (SELECT unnest(l) AS p, o, l FROM g), y AS (SELECT p, arg_max(l, o) AS l FROM x GROUP BY p) SELECT p AS l_partkey, array_to_string(list_filter(l, lambda z: z <> p), ',') AS others FROM y",
    "twin_pairs": "SELECT CAST(floor(c_custkey / 2) AS BIGINT) AS pair, CAST(min(c_custkey) AS VARCHAR) AS first, CASE WHEN count(*) = 1 THEN concat(min(c_custkey), '_original') ELSE CAST(max(c_custkey) AS VARCHAR) END AS second FROM customer WHERE c_custkey % 10 <> 3 GROUP BY 1",
    "partners_elsewhere": "WITH r AS (SELECT c_custkey, c_nationkey, row_number() OVER (ORDER BY md5(concat('9:', c_nationkey)), c_nationkey, md5(concat('9:', c_custkey)), c_custkey) AS n, count(*) OVER () AS t, count(*) OVER (PARTITION BY c_nationkey) AS s FROM customer) SELECT x.c_custkey, y.c_custkey AS partner FROM r x JOIN r y ON y.n = (x.n - 1 + x.s) % x.t + 1 WHERE x.s < x.t",
    "interleaved": "SELECT s_suppkey AS place, CAST(s_suppkey % 3 % 2 AS INT) AS side, CASE WHEN s_suppkey % 3 % 2 = 0 THEN c_name ELSE s_name END AS name FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey WHERE s_suppkey % 3 % 2 = 1 OR c_name IS NOT NULL",
    "other_printers": "SELECT n_name AS name, count(DISTINCT l_partkey) AS parts FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
    "cross_references": "SELECT s_nationkey, count(DISTINCT x.l_orderkey) AS issues, count(DISTINCT x.l_partkey) AS letters, count(DISTINCT y.l_suppkey) AS books FROM lineitem x JOIN lineitem y ON x.l_partkey = y.l_partkey AND x.l_suppkey = 7 AND y.l_suppkey <> 7 JOIN supplier ON y.l_suppkey = s_suppkey GROUP BY 1",
    "page_breakdown": "SELECT l_partkey, string_agg(concat(l_suppkey, ':', l_linenumber), ', ' ORDER BY l_suppkey, l_linenumber) AS breakdown FROM (SELECT DISTINCT l_partkey, l_suppkey, l_linenumber FROM lineitem) GROUP BY 1",
}
