"""Line deduplication by content-defined chunks of lines.

A chunk ends after a line if the rolling hash over it and the line before (hash * BASE + hash) is divisible by `divisor`, and
at the text's end; so an inserted or changed line moves no boundary but those beside it. The pieces that are compared are the chunks of
two lines or more and, as a repeated passage may begin and end inside chunks, the pairs of adjacent lines of `pair_chars`
characters or more: chunks find repeated runs of short lines, pairs grow them to their edges and find short runs. Of equal
pieces that hold more than white space the first (by id, then text, then place) stays; the lines of all others go. A line that goes
has an equal one before it in that order, so the first copy of every line stays.

Plan: texts are read once to a narrow table of line hashes. Pieces meet as sequences of line hashes, with map-side
combine, so a passage that very many texts share arrives once per task; back to the texts, pieces that a 1024th of all pieces
equal are salted. Bytes are compared by lines: all lines whose hash is in a repeated piece are grouped by hash and text, and if a
hash holds different lines, those are compared by their text instead. Only texts that lose lines move; a bitmap
of fixed size keeps the others out of the shuffle.

Defined results: a null text counts as empty and stays null if nothing is removed; lines end at \\n only; rows that agree in id and
text are one document: they lose the same lines, and none to each other at the same place; a null id comes after all others;
an empty table gives an empty result; all columns of the input stay as they are but the text, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import SPACE, bitmap, materialize, may_be_in, table, text_or_empty

DIVISOR = 4
PAIR_CHARS = 60
BASE = 1000003
#: A piece that at least one in so many pieces equals is joined in SALTS parts; there can't be more such pieces than that.
HOT, SALTS = 1024, 64
#: Line hashes that are replaced by their text one by one; beyond, all lines are compared by text.
FEW = 1000


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _with_pieces(df: DataFrame, divisor: int, pair_chars: int) -> DataFrame:
    """Adds pieces: (start, n) of the chunks and pairs of `lines` to compare. One column a step, as a step that is used twice would be computed twice."""
    df = df.withColumn("h", F.transform("lines", _line_hash)).withColumn("size", F.size("lines"))
    before = F.concat(F.array(F.lit(0).cast("long")), F.slice("h", 1, F.size("h") - 1))
    df = df.withColumn("cut", F.zip_with("h", before, lambda x, b: (b * BASE + x) % divisor == 0))
    df = df.withColumn("ends", F.array_union(F.array_compact(F.transform("cut", lambda c, i: F.when(c, i + 1))), F.array("size")))
    df = df.withColumn("starts", F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.size("ends") - 1)))
    df = df.withColumn("long", F.transform("lines", lambda x: F.length(x))).withColumn("filled", F.transform("lines", lambda x: x.rlike(f"[^{SPACE}]")))
    df = df.withColumn("long", F.zip_with("long", F.slice("long", 2, F.greatest("size", F.lit(1))), lambda a, b: a + b >= pair_chars))  # null at the last line
    chunks = F.zip_with("starts", "ends", lambda s, e: F.struct(s.alias("start"), (e - s).alias("n")))
    pairs = F.array_compact(F.transform("long", lambda x, i: F.when(x, F.struct(i.alias("start"), F.lit(2).alias("n")))))
    df = df.withColumn("pieces", F.concat(chunks, pairs))
    return df.withColumn("pieces", F.filter("pieces", lambda p: (p["n"] >= 2) & F.exists(F.slice("filled", p["start"] + 1, p["n"]), lambda x: x)))


def _occurrences(rows: DataFrame, key: Callable[[Column], Column], divisor: int, pair_chars: int) -> DataFrame:
    """id, tag, start, n, key (the keys of its lines), place (what orders equal pieces) of each piece of the rows (id, tag, text)."""
    keyed = _with_pieces(rows.where(F.col("text").contains("\n")).withColumn("lines", _lines(F.col("text"))), divisor, pair_chars)
    keyed = materialize(keyed.select("id", "tag", F.transform("lines", lambda x: key(x)).alias("keys"), "pieces"))
    each = F.transform("pieces", lambda p: F.struct(p["start"], p["n"], F.slice("keys", p["start"] + 1, p["n"]).alias("key")))
    out = keyed.select("id", "tag", F.inline(each))
    big = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    of_text = (F.coalesce(F.col("id").cast("decimal(20,0)"), big(2**63)) * big(10**9)).cast("decimal(38,0)") + F.pmod(F.xxhash64("tag"), F.lit(10**9)).cast("decimal(20,0)")
    return out.withColumn("place", (of_text.cast("decimal(38,0)") * big(10**10)).cast("decimal(38,0)") + F.col("start").cast("decimal(10,0)")).withColumn("place", F.col("place").cast("decimal(38,0)"))


def _gone(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repeated pieces (key, copies, first), and per document the pieces that go: id, tag, gone (start, n)."""
    repeated = materialize(pieces.groupBy("key").agg(F.count("*").alias("copies"), F.min("place").alias("first")).where("copies > 1"))
    total = pieces.count()
    hot = [r.h for r in repeated.where(F.col("copies") >= max(2, total / HOT)).select(F.xxhash64("key").alias("h")).distinct().collect()]  # at most HOT
    h = F.xxhash64("key")
    salts = lambda some: some if hot else F.lit(0)
    groups = repeated.withColumn("salt", F.explode(salts(F.when(h.isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))) if hot else F.lit(0))
    found = may_be_in(pieces.withColumn("h", h), "h", bitmap(repeated.select(h)))
    found = found.withColumn("salt", salts(F.when(F.col("h").isin(hot), F.pmod(F.xxhash64("id", "tag", "start"), F.lit(SALTS)).cast("int")).otherwise(0)))
    gone = found.join(groups.select("key", "salt", "first"), ["key", "salt"]).where("place <> first").select("id", "tag", "start", "n").distinct()
    return repeated, materialize(gone.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "n")).alias("gone")))


def _shared_hashes(rows: DataFrame, repeated: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    """k: keys of lines of repeated pieces that stand for lines of different bytes."""
    wanted = repeated.select(F.explode("key").alias("k")).select(F.xxhash64("k").alias("h"))
    lines = rows.select(F.explode(_lines(F.col("text"))).alias("line")).withColumn("k", key(F.col("line"))).withColumn("h", F.xxhash64("k"))
    each = may_be_in(lines, "h", bitmap(wanted)).groupBy("k", "line").agg(F.count("*").alias("n"))
    return materialize(each.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"))


def line_dedup(
    docs: DataFrame, divisor: int = DIVISOR, pair_chars: int = PAIR_CHARS, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] | None = None, line_hash: Callable[[Column], Column] = F.xxhash64
) -> DataFrame:
    """docs with the lines of repeated pieces gone from the text; counts: names of columns to add for the number of lines before and of those removed."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text = text_or_empty(F.col(f"`{text_col}`"))
    rows = docs.select(row.alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.unhex(F.md5(text)).alias("tag"), text.alias("text"))
    narrow = rows.select("id", "tag", "text")
    repeated, gone = _gone(_occurrences(narrow, line_hash, divisor, pair_chars))
    shared = _shared_hashes(narrow, repeated, line_hash)
    if not shared.isEmpty():
        some = [r.k for r in shared.limit(FEW + 1).collect()]
        by_text = F.lit(True) if len(some) > FEW else None
        exact = lambda line: F.when(line_hash(line).isin(some) if by_text is None else by_text, F.concat(F.lit("t"), line)).otherwise(line_hash(line).cast("string"))
        _, gone = _gone(_occurrences(narrow, exact, divisor, pair_chars))
    rows = rows.withColumn("h", F.xxhash64("id", "tag"))
    losers = bitmap(gone.select(F.xxhash64("id", "tag").alias("h")))
    none = F.lit(None).cast("array<struct<start:int,n:int>>")
    moved = may_be_in(rows, "h", losers).join(gone.withColumnsRenamed({"id": "i", "tag": "t"}), F.col("id").eqNullSafe(F.col("i")) & (F.col("tag") == F.col("t")), "left").drop("i", "t")
    out = may_be_in(rows, "h", losers, negate=True).withColumn("gone", none).unionByName(moved)
    out = out.withColumn("lines", _lines(F.col("text")))
    lost = F.flatten(F.transform("gone", lambda g: F.sequence(g["start"], g["start"] + g["n"] - 1)))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), lost)
    out = out.withColumn("kept", F.when(F.col("gone").isNotNull(), kept))
    field = lambda c: F.col("row").getField(c).alias(c)
    left = F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n")
    columns = [F.when(F.col("gone").isNull(), field(c)).otherwise(left).alias(c) if c == text_col else field(c) for c in docs.columns if c not in (counts or ())]
    if counts:
        n = F.size("lines").cast("long")
        columns += [n.alias(counts[0]), F.when(F.col("gone").isNull(), F.lit(0).cast("long")).otherwise(n - F.size("kept")).alias(counts[1])]
    return out.select(*columns)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), counts=("n_lines", "n_removed"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(text_or_empty("text"), 256).alias("text_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), h AS (
  SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM l
), b AS (
  SELECT *, (lag(h, 1, 0) OVER w * 1000003 + h) % 4 = 0 AS cut, lead(line) OVER w AS following FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), c AS (
  SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM b
), p AS (
  SELECT doc_id, min(i) AS start, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS body FROM c GROUP BY doc_id, k HAVING count(*) >= 2
  UNION SELECT doc_id, i, 2, line || chr(10) || following FROM c WHERE length(line) + length(following) >= 60
), f AS (
  SELECT *, min((doc_id, start)) OVER (PARTITION BY body) AS first FROM p WHERE regexp_matches(body, '[^\x20\x09-\x0D]')
), g AS (
  SELECT DISTINCT doc_id, unnest(range(start, start + n)) AS i, true AS gone FROM f WHERE (doc_id, start) <> first
)
SELECT l.doc_id, count(*) AS n_lines, count(gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (gone IS NULL), '')) AS text_sha256
FROM l LEFT JOIN g USING (doc_id, i) GROUP BY l.doc_id
"""
