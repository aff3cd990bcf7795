"""Queries on manifests, splits, names and filters, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quoin.functions import names
from quoin.operators import joins, ranking
from quoin.sources.tables import table


def top_percent_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_percent(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), None, "o_totalprice", 2.5, "o_orderkey")


def top_fraction_per_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_fraction(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderstatus", "o_totalprice", 0.013, "o_orderkey")


def top_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_totalprice > 1000")
    return o.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey")


def prefix_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.prefix_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", {"train": 0.8, "valid": 0.1}, "test", 3)


def alternating_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.alternating_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", ("test", "valid"), 4)


def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.group_split(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", {"train": 0.8, "valid": 0.1, "test": 0.1}, 5)


def balanced_with_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.balanced(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["o_orderkey"], 301)


def class_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.batches(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 16, 6)


def value_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return ranking.ordinal(ranking.ordinal(e, "user_id", name="by_value"), "event_type", "event_id", "by_first").select("event_id", "by_value", "by_first")


def consecutive_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.consecutive_pairs(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 8)


def first_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.lit(1).alias("source"), F.col("p_partkey").alias("place"))
    q = table(spark, sf_dir, "part").where("p_size < 5").select(F.col("p_brand").alias("name"), F.lit(0).alias("source"), F.col("p_partkey").alias("place"))
    return ranking.first_by(p.unionByName(q), "name", ["source", "place"])


def missing_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    ranking.assert_disjoint(ranking.missing_values(c, o, "k"), o, "k")
    return ranking.missing_values(c, o, "k")


def repeated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.repeated(table(spark, sf_dir, "region"), 3).select("r_regionkey", "round")


def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    first = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return e.withColumn("at", F.row_number().over(first)).where("at <= 6").select("event_id")


def every_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of every customer and status, also of those without any."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    domain = c.select(F.col("c_custkey").alias("o_custkey")).join(o.select("o_orderstatus").distinct())
    per = o.groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("price"))
    return ranking.completed(per, domain, ["o_custkey", "o_orderstatus"], {"n": 0, "price": 0.0}).select("o_custkey", "o_orderstatus", "n", F.round("price", 2).alias("price"))


def chosen_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two parts of each brand in seeded order, from a folder of files in folders."""
    p = table(spark, sf_dir, "part").select("p_brand", F.concat(F.lit("/d/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"), F.lit(".tif")).alias("path"))
    return ranking.first_seeded(p, ["p_brand"], "path", 2, 11)


_BUILT = """concat('/data/', if(o_orderkey % 7 = 0, 'letters/', 'char_'), char(65 + o_custkey % 26), '/anon_R', o_custkey, '_iur_8_essayREDO', year(o_orderdate), if(o_orderkey % 5 = 0, 'B', ''), '-',
    lpad(cast(o_orderkey % 900 AS string), 4, '0'), if(o_orderkey % 3 = 0, concat('_chunk_', lpad(cast(o_custkey % 200 AS string), 3, '0'), '.jpg'), concat('_page1rline2_char3_', char(97 + o_orderkey % 26),
    if(o_orderkey % 4 = 0, '_uc', ''), if(o_orderkey % 2 = 0, concat('_x', o_custkey, '_y', o_orderkey % 50), ''), '.tif')))"""
_BUILT_SQL = """concat('/data/', CASE WHEN o_orderkey % 7 = 0 THEN 'letters/' ELSE 'char_' END, chr(CAST(65 + o_custkey % 26 AS INT)), '/anon_R', o_custkey, '_iur_8_essayREDO', year(o_orderdate), CASE WHEN o_orderkey % 5 = 0 THEN 'B' ELSE '' END, '-',
    lpad(CAST(o_orderkey % 900 AS VARCHAR), 4, '0'), CASE WHEN o_orderkey % 3 = 0 THEN concat('_chunk_', lpad(CAST(o_custkey % 200 AS VARCHAR), 3, '0'), '.jpg') ELSE concat('_page1rline2_char3_', chr(CAST(97 + o_orderkey % 26 AS INT)),
    CASE WHEN o_orderkey % 4 = 0 THEN '_uc' ELSE '' END, CASE WHEN o_orderkey % 2 = 0 THEN concat('_x', o_custkey, '_y', o_orderkey % 50) ELSE '' END, '.tif') END)"""


def path_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.col("path")
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_BUILT).alias("path"))
    return df.select(
        "o_orderkey", names.base_name(path).alias("base"), names.parent_name(path).alias("parent"), names.stem(path).alias("stem"), names.letter_class(path).alias("letter"), names.graph_letter(path).alias("graph_letter"),
        names.chunk_number(path).alias("chunk"), names.folio_part(F.lpad((F.col("o_orderkey") % 900).cast("string"), 4, "0")).alias("folio"), F.get(names.damage_place(path), 0).alias("x"), F.get(names.damage_place(path), 1).alias("y"),
        names.composite(names.letter_class(path), names.chunk_number(path)).alias("both"), names.two_digits(F.col("o_orderkey") % 120).alias("digits"), names.moved_path(path, "letters", "/data/", "/mnt/").alias("moved"),
        names.listed_page(path).alias("page"), names.year_past_part(names.base_name(path)).alias("year"), names.book_by_title(names.base_name(path)).alias("book"), names.book_by_pattern(names.base_name(path)).alias("pattern_book"),
    )


_SIGNATURE = "CASE c_custkey % 6 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN left(c_mktsegment, 1) WHEN 2 THEN left(c_mktsegment, 2) WHEN 3 THEN concat(left(c_mktsegment, 2), c_custkey % 30) WHEN 4 THEN concat(left(c_mktsegment, 1), c_custkey % 30) ELSE c_name END"


def gathering_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_SIGNATURE).alias("signature"), names.level(F.col("c_mktsegment"), ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]).alias("level"))
    return df.select("c_custkey", "level", names.gathering_key(F.col("signature")).alias("k")).select("c_custkey", "level", "k.*")


def workbench_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("concat(char(65 + p_size % 26), '_uc - (', p_partkey, ') ', if(p_size % 2 = 0, 'Two essays', 'A Treatise'), ' in... p. ', p_size, if(p_size % 3 = 0, '-s', ''), ' l. ', p_partkey % 40, if(p_size % 5 = 0, '', concat(' c. ', p_partkey % 9, '.jpg')))")
    df = table(spark, sf_dir, "part").select("p_partkey", name.alias("name"))
    rule = names.first_rule(F.col("name"), [("two essays", "essays"), ("treatise", "treatise")], F.lit("other"))
    return df.select("p_partkey", names.workbench_fields(F.col("name")).alias("f"), rule.alias("book"), names.standard_book(rule, {"essays": "Two Essays"}).alias("standard")).select("p_partkey", "f.*", "book", "standard")


def perturbed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr("concat('x_char', o_custkey, '_perturb', o_orderkey % 9, '_anomaly_', o_orderkey, if(o_orderkey % 4 = 0, '_original.tif', concat('_damage_', if(o_orderkey % 3 = 0, 'bend', 'bend_thin'), '_globalink_a_localink_', char(97 + o_custkey % 26), '_', 1 + o_orderkey % 3, '.tif')))")
    df = table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name"))
    out = df.select("o_orderkey", names.perturbation(F.col("name")).alias("p"), names.perturbation_tokens(F.col("name")).alias("t"))
    return out.select("o_orderkey", "p.stamp", "p.kind", "p.timestamp", F.array_join("p.damages", "+").alias("damages"), "p.local_ink", F.col("t.id").alias("token"))


def paragraph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.regexp_replace("text", r"\. ", ".\n \n")
    lines = table(spark, sf_dir, "documents").select("doc_id", F.inline(names.paragraph_groups(text)))
    return lines.groupBy("doc_id").agg(F.count_distinct("group").alias("groups"), F.count("*").alias("lines"))


def absent_or_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return joins.keep_if_absent_or_above(table(spark, sf_dir, "customer").select("c_custkey"), scores, "c_custkey", "o_totalprice", 300000.0)


def closed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 600).alias("page"), "o_orderstatus", F.nullif(F.substring("o_orderpriority", 3, 40), F.lit("LOW")).alias("word"))
    o = o.where(F.col("page").between(257, 464) & (F.col("o_orderstatus") != "P"))
    return o.select("o_orderkey", names.filled(F.col("word"), F.col("o_orderstatus")).alias("word"), names.is_missing(F.col("word")).alias("missing"))


def any_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    side = F.when(joins.holds_any(F.col("p_type"), ["A", "TIN"]), "with").otherwise("without")
    return p.groupBy(side.alias("side")).agg(F.count("*").alias("n"))


def glob_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return joins.pattern_join(p, [(1, "Brand#1*"), (2, "*[24]"), (3, "Brand?3?")], "p_brand", glob=True).select("p_partkey", "pattern_id")


def first_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.createDataFrame([(0.0, 300.0, "A", 2), (100.0, 150.0, "B", 1), (250.0, 450.0, "C", 3)], "lo double, hi double, part string, ord int")
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 600).cast("double").alias("page"), "o_orderstatus")
    return joins.range_assign(o, ranges, "page", "o_orderkey", "ord", "part", F.col("o_orderstatus"), 10.0).select("o_orderkey", "assigned")


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "map<string, int>").alias("m"))
    per = e.select("event_type", F.explode("m").alias("key", "v")).groupBy("event_type", "key").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    m = per.groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("n", "total")))).alias("m"))
    return m.select("event_type", F.explode("m").alias("key", "v")).select("event_type", "key", "v.n", "v.total")


def cube_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return out.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n")


_SEED = "row_number() OVER (ORDER BY md5(concat('{}:', {})), {})"
QUERIES = {f.__name__: f for f in (top_percent_overall, top_fraction_per_status, top_above, prefix_split, alternating_split, group_split, balanced_with_limit, class_batches, value_ordinals, consecutive_pairs, first_by_name, missing_customers, repeated_rows, first_events, every_status, chosen_files, path_fields, gathering_order, workbench_rows, perturbed_names, paragraph_lines, absent_or_above, closed_pages, any_word, glob_matches, first_range, event_props, cube_counts)}
ORACLES = {
    "top_percent_overall": "SELECT o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) <= ceil(count(*) OVER () * 2.5::DOUBLE / 100)",
    "top_fraction_per_status": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) <= floor(count(*) OVER (PARTITION BY o_orderstatus) * 0.013::DOUBLE)",
    "top_above": "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "prefix_split": f"WITH r AS (SELECT o_orderkey, {_SEED.format(3, 'o_orderkey', 'o_orderkey')} AS r, count(*) OVER () AS n FROM orders) SELECT o_orderkey, CASE WHEN r <= round_even(n * 0.8::DOUBLE, 0) THEN 'train' WHEN r <= round_even(n * 0.8::DOUBLE, 0) + round_even(n * 0.1::DOUBLE, 0) THEN 'valid' ELSE 'test' END AS part FROM r",
    "alternating_split": f"SELECT o_orderkey, CASE WHEN {_SEED.format(4, 'o_orderkey', 'o_orderkey')} % 2 = 1 THEN 'test' ELSE 'valid' END AS part FROM orders",
    "group_split": f"WITH g AS (SELECT o_custkey, {_SEED.format(5, 'o_custkey', 'o_custkey')} AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders)) SELECT o_orderkey, o_custkey, CASE WHEN r <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.9::DOUBLE) THEN 'valid' ELSE 'test' END AS part FROM orders JOIN g USING (o_custkey)",
    "balanced_with_limit": "WITH c AS (SELECT min(n) AS least, count(*) AS labels FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderstatus)) SELECT o_orderkey, o_orderstatus FROM orders, c QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= least(least, 301 // labels)",
    "class_batches": "WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat('6:', c_custkey)), c_custkey) AS r, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) SELECT c_custkey, c_mktsegment, (r - 1) // 16 AS batch FROM r WHERE (r - 1) // 16 < n // 16",
    "value_ordinals": "SELECT event_id, dense_rank() OVER (ORDER BY user_id) - 1 AS by_value, f - 1 AS by_first FROM events JOIN (SELECT event_type, row_number() OVER (ORDER BY min(event_id)) AS f FROM events GROUP BY event_type) USING (event_type)",
    "consecutive_pairs": f"WITH r AS (SELECT c_custkey, {_SEED.format(8, 'c_custkey', 'c_custkey')} AS r FROM customer) SELECT (r - 1) // 2 AS pair, max(c_custkey) FILTER (r % 2 = 1) AS first, max(c_custkey) FILTER (r % 2 = 0) AS second FROM r GROUP BY 1",
    "first_by_name": "SELECT p_brand AS name, CAST(min(CASE WHEN p_size < 5 THEN 0 ELSE 1 END) AS INT) AS source, coalesce(min(p_partkey) FILTER (p_size < 5), min(p_partkey)) AS place FROM part GROUP BY p_brand",
    "missing_customers": "SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "repeated_rows": "SELECT r_regionkey, CAST(i AS INT) AS round FROM region, range(1, 4) t(i)",
    "every_status": "WITH p AS (SELECT o_custkey, o_orderstatus, count(*) AS n, sum(o_totalprice) AS price FROM orders GROUP BY ALL) SELECT c_custkey AS o_custkey, s.o_orderstatus, coalesce(n, 0) AS n, round(coalesce(price, 0), 2) AS price FROM customer CROSS JOIN (SELECT DISTINCT o_orderstatus FROM orders) s LEFT JOIN p ON p.o_custkey = c_custkey AND p.o_orderstatus = s.o_orderstatus",
    "chosen_files": "WITH p AS (SELECT p_brand, concat('/d/', p_brand, '/', p_partkey, '.tif') AS path FROM part) SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY md5(concat('11:', path)), path) <= 2",
    "first_events": "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) <= 6",
    "path_fields": f"""WITH p AS (SELECT *, {_BUILT_SQL} AS path FROM orders), b AS (SELECT *, split_part(path, '/', -1) AS base, CASE WHEN o_orderkey % 7 = 0 THEN chr(CAST(65 + o_custkey % 26 AS INT)) ELSE concat('char_', chr(CAST(65 + o_custkey % 26 AS INT))) END AS parent FROM p), c AS (
SELECT *, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 4 = 0 THEN chr(CAST(97 + o_orderkey % 26 AS INT)) WHEN o_orderkey % 7 = 0 THEN parent WHEN NOT contains(base, 'uc') THEN right(split_part(base, '.', 1), 1) END AS letter,
CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey % 200 AS INT) ELSE try_cast(split_part(split_part(base, '_', -1), '.', 1) AS INT) END AS chunk FROM b)
SELECT o_orderkey, base, parent, left(base, length(base) - 4) AS stem, letter,
CASE WHEN o_orderkey % 3 = 0 THEN CASE WHEN length(parent) = 1 THEN parent END WHEN length(split_part(base, '_', 8)) = 1 THEN split_part(base, '_', 8) END AS graph_letter, chunk,
CASE WHEN o_orderkey % 900 <= 292 THEN 1 WHEN o_orderkey % 900 <= 620 THEN 2 ELSE 3 END AS folio,
CAST(CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 THEN o_custkey ELSE -1 END AS INT) AS x, CAST(CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0 THEN o_orderkey % 50 ELSE -1 END AS INT) AS y,
letter || chunk AS both, CASE WHEN o_orderkey % 120 < 10 THEN concat('0', o_orderkey % 120) ELSE CAST(o_orderkey % 120 AS VARCHAR) END AS digits, CASE WHEN contains(path, 'letters') THEN replace(path, '/data/', '/mnt/') ELSE path END AS moved,
CAST(o_orderkey % 900 AS INT) AS page, CAST(year(o_orderdate) AS INT) AS year,
concat('essay', year(o_orderdate), CASE WHEN o_orderkey % 5 = 0 THEN 'B' ELSE '' END) AS book, CASE WHEN o_orderkey % 3 <> 0 THEN concat('essayREDO', year(o_orderdate)) END AS pattern_book FROM c""",
    "gathering_order": f"""WITH s AS (SELECT c_custkey, c_mktsegment, {_SIGNATURE} AS s FROM customer), m AS (SELECT *, regexp_extract(s, '^([A-Z]+)([0-9]*)$', 1) AS u, regexp_extract(s, '^([A-Z]+)([0-9]*)$', 2) AS d FROM s)
SELECT c_custkey, CAST(CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'HOUSEHOLD' THEN 3 ELSE 4 END AS INT) AS level,
CAST(CASE WHEN regexp_matches(s, '^[a-z]+$') THEN 0 WHEN u = '' THEN 999 WHEN d = '' AND length(u) <= 3 THEN length(u) WHEN d <> '' AND length(u) <= 2 THEN length(u) + 3 ELSE 6 END AS INT) AS category, CASE WHEN u <> '' THEN u ELSE s END AS letters, coalesce(try_cast(d AS BIGINT), 0) AS number FROM m""",
    "workbench_rows": "SELECT p_partkey, chr(65 + p_size % 26) AS letter, CAST(p_size AS VARCHAR) AS page, CAST(p_partkey % 40 AS VARCHAR) AS line, CASE WHEN p_size % 5 <> 0 THEN CAST(p_partkey % 9 AS VARCHAR) END AS slot, CASE WHEN p_size % 2 = 0 THEN 'essays' ELSE 'treatise' END AS book, CASE WHEN p_size % 2 = 0 THEN 'Two Essays' ELSE 'treatise' END AS standard FROM part",
    "perturbed_names": """SELECT o_orderkey, CASE WHEN k THEN concat('x_char', o_custkey, '_perturb') END AS stamp, CASE WHEN k THEN 'anomaly' END AS kind, CASE WHEN k THEN o_orderkey END AS timestamp,
CASE WHEN k AND o_orderkey % 4 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'bend' ELSE 'bend+thin' END END AS damages, CASE WHEN k AND o_orderkey % 4 <> 0 THEN chr(CAST(97 + o_custkey % 26 AS INT)) END AS local_ink,
CASE WHEN o_orderkey % 4 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'localink' ELSE 'a' END END AS token FROM (SELECT *, o_orderkey % 4 = 0 OR o_orderkey % 3 <> 2 AS k FROM orders)""",
    "paragraph_lines": r"""WITH g AS (SELECT doc_id, unnest(list_filter(string_split_regex(replace(text, '. ', '.' || chr(10) || ' ' || chr(10)), '\n\s*\n'), lambda x: trim(x) <> '')) AS g FROM documents)
SELECT doc_id, count(*) AS groups, CAST(sum(len(list_filter(string_split(g, chr(10)), lambda x: trim(x) <> ''))) AS BIGINT) AS lines FROM g GROUP BY doc_id""",
    "absent_or_above": "SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS s FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE s IS NULL OR s > 300000",
    "closed_pages": "SELECT o_orderkey, CASE WHEN substr(o_orderpriority, 3) IN ('LOW', '') THEN o_orderstatus ELSE substr(o_orderpriority, 3) END AS word, substr(o_orderpriority, 3) IN ('LOW', '') AS missing FROM orders WHERE o_orderkey % 600 BETWEEN 257 AND 464 AND o_orderstatus <> 'P'",
    "any_word": "SELECT CASE WHEN contains(p_type, 'A') OR contains(p_type, 'TIN') THEN 'with' ELSE 'without' END AS side, count(*) AS n FROM part GROUP BY 1",
    "glob_matches": "SELECT p_partkey, CAST(i AS INT) AS pattern_id FROM part JOIN (VALUES (1, 'Brand#1*'), (2, '*[24]'), (3, 'Brand?3?')) r(i, q) ON p_brand GLOB q",
    "first_range": "SELECT o_orderkey, CASE WHEN o_orderkey % 600 >= 100 AND o_orderkey % 600 < 150 THEN 'B' WHEN o_orderkey % 600 < 300 THEN 'A' WHEN o_orderkey % 600 < 450 THEN 'C' ELSE o_orderstatus END AS assigned FROM orders",
    "event_props": "SELECT event_type, 'k' AS key, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS INT)) AS BIGINT) AS total FROM events GROUP BY event_type",
    "cube_counts": "SELECT coalesce(l_returnflag, 'all') AS flag, coalesce(l_linestatus, 'all') AS status, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
}
