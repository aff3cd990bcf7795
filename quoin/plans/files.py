"""Queries that write files to the shared folder and read them back through the sources, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quoin.sources import binary, sinks, text
from quoin.sources.storage import shared_path
from quoin.sources.tables import table
from quoin.streaming import manifests


def _written(df: DataFrame, column: str, name: str) -> str:
    path = shared_path(df.sparkSession, name)
    sinks.write_lines(df, column, path)
    return path


_LINE = "CASE o_orderkey % 5 WHEN 0 THEN concat('o', o_orderkey) WHEN 1 THEN concat('o', o_orderkey, ',n/a') ELSE concat('o', o_orderkey, ', ', o_custkey, ',more') END"


def tolerant_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.scored_list(spark, _written(table(spark, sf_dir, "orders").select(F.expr(_LINE).alias("line")), "line", "scores"))


def streamed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, out = _written(table(spark, sf_dir, "orders").select(F.expr(_LINE).alias("line")), "line", "stream"), shared_path(spark, "streamed")
    stream = manifests.scored_lines(spark, source)
    # the batch's number names its folder, so a batch that comes again replaces itself
    manifests.run_batches(stream, shared_path(spark, "offsets"), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}")).awaitTermination()
    return spark.read.schema("path string, score double").parquet(f"{out}/*").select("path", "score")


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "part").select(F.expr("if(p_partkey % 4 = 0, '  ', concat(' /d/', p_brand, '/', p_partkey, '.tif '))").alias("line"))
    listed = text.file_list(spark, _written(lines, "line", "list"))
    return text.labelled_union([(listed, 1), (listed.where(F.col("path").contains("#1")), 0)]).groupBy("label").agg(F.count("*").alias("n"), F.max("path").alias("last"))


def match_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("l_partkey")), lambda x: x.cast("string")), ", ").alias("names"))
    lines = per.select(F.expr("CASE l_orderkey % 7 WHEN 0 THEN concat('# ', names) WHEN 1 THEN ' ' ELSE names END").alias("line"))
    return text.match_groups(spark, _written(lines, "line", "matches")).groupBy(F.size("names").alias("size")).agg(F.count("*").alias("lines"))


def wide_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("candidate"), F.col("o_totalprice").alias("score"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "candidate")
    ranked = e.withColumn("rank", F.row_number().over(best)).where("rank <= 4")
    return text.wide_neighbours(spark, _written(sinks.wide_rows(ranked, 4), "row", "wide")).withColumn("score", F.round("score", 3))


def archived_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts packed into an archive for each brand and read back beside the brand's table of thresholds."""
    p = table(spark, sf_dir, "part")
    letter = F.substring("p_name", 1, 1)
    rows = p.select(F.regexp_replace("p_brand", "#", "_").alias("book"), F.concat(F.lit("x"), "p_partkey", F.lit("_"), letter, F.lit("_uc.tif")).alias("file"), F.encode("p_name", "UTF-8").alias("content"), "p_size")
    tars, tables = shared_path(spark, "tars"), shared_path(spark, "tables")
    binary.write_tars(rows, "book", "file", "content", tars)
    # brands that end in 7 have no table
    rows.where("book NOT LIKE '%7'").select("book", "file", "p_size").write.partitionBy("book").csv(tables)
    listed = spark.read.schema("file string, threshold int, book string").csv(tables)
    found = binary.members_in_table(binary.tar_members(spark, f"{tars}/*.tar", "_b_uc.tif", True), listed, "file")
    return found.select("file", "book", "threshold", F.decode("content", "UTF-8").alias("name"))


def stored_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as bytes in IDX files, read back: their sums by file and place."""
    grey = F.transform("embedding", lambda v: F.least(F.greatest(F.floor(v.cast("double") * 500 + 128), F.lit(0)), F.lit(255)).cast("int"))
    path = shared_path(spark, "idx")
    binary.write_idx(table(spark, sf_dir, "embeddings").select("vec_id", grey.alias("grey")), ["vec_id"], "grey", [8, 8], path, 100, pack=True)
    items = binary.idx_items(spark, f"{path}/*.gz")
    return items.select((F.regexp_extract("file", r"part-(\d+)", 1).cast("long") * 100 + F.col("item")).alias("vec_id"), F.aggregate("values", F.lit(0), lambda a, x: a + x).cast("long").alias("ink"), F.array_join("shape", "x").alias("shape"))


def log_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", "event_id", F.concat(F.lit("*** ['"), "event_type", F.lit("'] best_value: "), F.format_string("%.2f", "value"), F.when(F.col("event_id") % 3 == 0, "").otherwise(" >>> step")).alias("line"))
    path = shared_path(spark, "logs")
    # a log is a folder of files by the first digits of its lines' numbers, each in order
    e.withColumn("chunk", F.format_string("c%012d", F.floor(F.col("event_id") / 1000))).repartition("event_type", "chunk").sortWithinPartitions("event_type", "chunk", "event_id").select("event_type", "chunk", "line").write.partitionBy("event_type", "chunk").text(path)
    found = text.log_values(spark, path, r"\*\*\* \['([a-z_]+)'\] best_value: ([0-9.]+)", folders=["event_type", "chunk"])
    per = found.groupBy("event_type", "name").agg(F.count("*").alias("n"), F.max_by("value", F.struct("chunk", "file", "ord")).alias("last"), F.max("value").alias("best"))
    return per.select("name", "n", "last", "best")


def key_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "keys")
    sinks.write_by_key(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), "p_brand", path)
    return spark.read.parquet(path).where("p_brand LIKE 'Brand#1%'").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n"), F.sum("p_size").alias("size"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "notes")
    sinks.write_annotations(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("row"), "n_name"), path, "row", "n_name")
    j, c = text.by_extension(spark, f"{path}/json/part-*.json"), text.delimited(spark, f"{path}/csv", {"place": "int", "name": "string"})
    return j.join(c, j["row"] == c["place"]).select(F.col("place"), "name", (F.col("column") == F.col("name")).alias("same"))


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.long_metrics(table(spark, sf_dir, "nation"), F.col("n_regionkey"), F.col("n_nationkey"), {"key": F.col("n_nationkey"), "length": F.length("n_name")})


def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("page"), F.col("p_brand").alias("book"), F.expr("concat(p_brand, if(p_partkey % 2 = 0, 'REDO', ''), '-', p_partkey)").alias("path"))
    wanted = table(spark, sf_dir, "part").select(F.col("p_size").alias("page"), F.concat(F.substring("p_brand", 1, 7), F.lit("1")).alias("book")).distinct()
    return text.resolved(wanted, p, ["page", "book"])


def picture_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.unhex(F.expr("element_at(array('89504E470D0A', 'FFD8FFE0', '474946383961', '00FFD8FF', '4D4D002A', '424D', ''), cast(p_partkey % 7 + 1 AS int))"))
    return table(spark, sf_dir, "part").select((F.col("p_partkey") % 7).alias("kind"), text.is_picture(content).alias("valid")).groupBy("kind", "valid").agg(F.count("*").alias("n"))


def saved_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("n_name", F.struct(F.col("n_nationkey").alias("x"), F.col("n_regionkey").alias("y")))))).alias("layout"))
    return binary.layout_positions(per, "layout")


def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, out = shared_path(spark, "events"), shared_path(spark, "windows")
    table(spark, sf_dir, "events").select("event_id", "ts", "event_type").write.parquet(source)
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string").parquet(source)
    counts = manifests.window_counts(stream, "ts", "event_type", "1 day", "0 seconds")
    # only windows that the watermark has passed are final
    counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", shared_path(spark, "offsets")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_type string, start timestamp, n long").parquet(out).select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), "n")


QUERIES = {f.__name__: f for f in (tolerant_scores, streamed_scores, file_names, match_groups, wide_neighbours, archived_letters, stored_items, log_metrics, key_folders, annotations, metric_rows, resolved_names, picture_kinds, saved_layout, streamed_windows)}
_SCORES = "SELECT concat('o', o_orderkey) AS path, CAST(o_custkey AS DOUBLE) AS score FROM orders WHERE o_orderkey % 5 > 1"
ORACLES = {
    "tolerant_scores": _SCORES,
    "streamed_scores": _SCORES,
    "file_names": "WITH p AS (SELECT concat('/d/', p_brand, '/', p_partkey, '.tif') AS p FROM part WHERE p_partkey % 4 <> 0) SELECT CAST(1 AS INT) AS label, count(*) AS n, max(p) AS last FROM p UNION ALL SELECT CAST(0 AS INT), count(*), max(p) FROM p WHERE contains(p, '#1')",
    "match_groups": "WITH g AS (SELECT l_orderkey, count(DISTINCT l_partkey) AS n FROM lineitem WHERE l_orderkey % 7 > 1 GROUP BY 1) SELECT CAST(n AS INT) AS size, count(*) AS lines FROM g WHERE n >= 2 GROUP BY n",
    "wide_neighbours": "SELECT CAST(o_custkey AS VARCHAR) AS query, CAST(row_number() OVER w AS INT) AS rank, CAST(o_orderkey AS VARCHAR) AS candidate, round(o_totalprice, 3) AS score FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) QUALIFY row_number() OVER w <= 4",
    "archived_letters": "SELECT concat('x', p_partkey, '_b_uc.tif') AS file, replace(p_brand, '#', '_') AS book, CAST(p_size AS INT) AS threshold, p_name AS name FROM part WHERE p_name LIKE 'b%' AND p_brand NOT LIKE '%7'",
    "stored_items": "SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda v: least(greatest(floor(CAST(v AS DOUBLE) * 500 + 128), 0), 255))) AS BIGINT) AS ink, '8x8' AS shape FROM embeddings",
    "log_metrics": "SELECT event_type AS name, count(*) AS n, CAST(printf('%.2f', arg_max(value, event_id)) AS DOUBLE) AS last, CAST(printf('%.2f', max(value)) AS DOUBLE) AS best FROM events GROUP BY 1",
    "key_folders": "SELECT p_brand AS brand, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS size FROM part WHERE p_brand LIKE 'Brand#1%' GROUP BY 1",
    "annotations": "SELECT n_nationkey AS place, n_name AS name, true AS same FROM nation",
    "metric_rows": "SELECT n_regionkey AS run, n_nationkey AS epoch, 'key' AS metric, CAST(n_nationkey AS DOUBLE) AS value FROM nation UNION ALL SELECT n_regionkey, n_nationkey, 'length', length(n_name) FROM nation",
    "resolved_names": "WITH p AS (SELECT p_size AS page, p_brand AS book, p_partkey % 2 = 0 AS later, concat(p_brand, CASE WHEN p_partkey % 2 = 0 THEN 'REDO' ELSE '' END, '-', p_partkey) AS path FROM part), w AS (SELECT DISTINCT p_size AS page, concat(substr(p_brand, 1, 7), '1') AS book FROM part) SELECT w.page, w.book, arg_min(path, (later, path)) AS path, count(path) AS candidates FROM w LEFT JOIN p USING (page, book) GROUP BY ALL",
    "picture_kinds": "SELECT p_partkey % 7 AS kind, p_partkey % 7 IN (0, 1, 2, 4, 5) AS valid, count(*) AS n FROM part GROUP BY ALL",
    "saved_layout": "SELECT n_name AS node, n_nationkey AS x, n_regionkey AS y FROM nation",
    "streamed_windows": "WITH e AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY ALL) SELECT * FROM e WHERE day < (SELECT max(day) FROM e)",
}
