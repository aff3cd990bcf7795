"""Text sources: file lists, scored lists, match groups, wide neighbour rows, logs. Lines that do not fit are left out, never an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def file_list(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path: the lines without white space at their ends, blank lines left out."""
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path <> ''")


def files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """path of the files whose name fits the pattern; contents are not read."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return read.load(folder).select("path")


def resolved(wanted: DataFrame, manifest: DataFrame, keys: list[str], less: str = "REDO") -> DataFrame:
    """wanted with the path of the manifest row of the same keys, one without `less` in it first, then the smallest, and the number of candidates (0: path is null)."""
    per = manifest.groupBy(*keys).agg(F.min(F.struct(F.col("path").contains(less).alias("later"), "path")).alias("best"), F.count("*").alias("n"))
    return wanted.join(per, keys, "left").select(*wanted.columns, F.col("best.path").alias("path"), F.coalesce("n", F.lit(0).cast("long")).alias("candidates"))


def scored_list(spark: SparkSession, path: str) -> DataFrame:
    """path, score of lines `path,score[,...]`; short lines and those whose score is no number are left out."""
    rows = spark.read.schema("path string, score string").option("mode", "PERMISSIVE").csv(path)
    return rows.select("path", F.trim("score").try_cast("double").alias("score")).where("path IS NOT NULL AND score IS NOT NULL")


def delimited(spark: SparkSession, path: str, names: dict[str, str], header: bool = True, sep: str = ",") -> DataFrame:
    """Columns by the given names and types, whatever a header calls them."""
    schema = ", ".join(f"`{n}` {t}" for n, t in names.items())
    return spark.read.schema(schema).option("header", str(header).lower()).option("enforceSchema", "true").option("sep", sep).csv(path)


def by_extension(spark: SparkSession, path: str) -> DataFrame:
    """A table from .parquet, .csv or .json; spreadsheets have no reader here and raise, as other extensions do."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "csv":
        return spark.read.option("header", "true").option("inferSchema", "false").csv(path)
    if kind == "json":
        return spark.read.json(path)
    raise ValueError(f"no reader for .{kind}: write it as .csv or .parquet")


def match_groups(spark: SparkSession, path: str) -> DataFrame:
    """group_id, names: the different names of each line that names two or more; lines that start with # and blank lines are left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' AND NOT startswith(line, '#')")
    names = F.array_distinct(F.filter(F.transform(F.split("line", ","), lambda x: F.trim(x)), lambda x: x != ""))
    return lines.select(F.xxhash64("line").alias("group_id"), names.alias("names")).where(F.size("names") >= 2)


def wide_neighbours(spark: SparkSession, path: str, sep: str = "|", k: int | None = None) -> DataFrame:
    """query, rank, candidate, score of lines query, k candidates, k scores; k from the number of separators where it isn't given; incomplete lines are left out."""
    cells = F.split("value", F.lit(f"\\Q{sep}\\E"), -1)
    rows = spark.read.text(path).select(cells.alias("c"))
    n = F.lit(k) if k is not None else F.floor((F.size("c") - 1) / 2).cast("int")
    rows = rows.select("c", n.alias("k")).where((F.col("k") > 0) & (F.size("c") == 2 * F.col("k") + 1))
    pairs = F.arrays_zip(F.slice("c", 2, F.col("k")).alias("candidate"), F.slice("c", F.col("k") + 2, F.col("k")).alias("score"))
    out = rows.select(F.get("c", 0).alias("query"), F.posexplode(pairs).alias("at", "p"))
    return out.select("query", (F.col("at") + 1).alias("rank"), "p.candidate", F.col("p.score").try_cast("double").alias("score")).where("score IS NOT NULL")


def log_values(spark: SparkSession, path: str, pattern: str, folders: list[str] | None = None) -> DataFrame:
    """file, ord, name, value: what a pattern of two groups finds in the lines of logs, numbered within its file, and the values of the folders (`name=value`) that it lies in.

    A file is one task's, as lines have no order otherwise: a long log should be a folder of files.
    """
    folders = folders or []
    logs = spark.read.option("wholetext", "true").option("basePath", path).text(path).select(F.col("_metadata.file_name").alias("file"), *[F.col(c).cast("string").alias(c) for c in folders], "value")
    found = F.arrays_zip(F.regexp_extract_all("value", F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all("value", F.lit(pattern), F.lit(2)).alias("value"))
    return logs.select("file", *folders, F.posexplode(found).alias("ord", "m")).select("file", *folders, "ord", "m.name", F.col("m.value").try_cast("double").alias("value"))


def labelled_union(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """path, label: file lists under one another, each with its label."""
    out = None
    for df, label in parts:
        one = df.select("path", F.lit(label).alias("label"))
        out = one if out is None else out.unionByName(one)
    return out


def is_picture(content: Column) -> Column:
    """Whether bytes start like a PNG, JPEG, GIF, BMP or TIFF."""
    head = F.hex(F.substring(content, 1, 4))
    return F.coalesce(head.isin("89504E47", "47494638", "49492A00", "4D4D002A") | head.startswith("FFD8FF") | head.startswith("424D"), F.lit(False))
