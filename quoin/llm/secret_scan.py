"""Secrets in all versions of texts, by an incremental ledger of content-addressed blobs.

Every version (a row) is addressed by the SHA-256 of its text. The ledger is a Parquet folder in which each row says which
(rule, version of the rule) pairs have been looked for in a blob and what they found; pairs in it are never scanned again. A
scan brings the distinct blobs together once, takes off each blob the pairs that the ledger has, scans those left, and
appends them. Findings are then joined to all versions that hold the blob, those of earlier scans too. A rule whose pattern
changes gets a new version number: then all blobs are unseen for that rule and for no other.

Texts move once, after equal ones met within their tasks, so that a large group of copies is one text a task. What is joined
to versions has no texts; blobs with very many versions are joined in parts. A scan that fails leaves the
ledger as it was; one that runs twice or at the same time as another only repeats rows, which count once.

Spans are leftmost non-overlapping matches, in code points. The base rules are those of the contract; a key block in PEM
armour is a rule besides.

Defined results: null counts as empty; the empty blob has no findings; versions that repeat an id, a path or a text are
versions of their own; an empty table gives an empty result and leaves the ledger as it was; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
import weakref
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import _written, join_to_groups, shared_dir, table, text_or_empty

_ENTRY = "blob binary, rules array<string>, findings array<struct<rule:string,start:long,`end`:long>>"


@dataclass(frozen=True)
class Rule:
    name: str
    version: int
    #: ASCII classes only: letters match in the cases that the pattern names
    pattern: str
    #: a match counts if this group of it has at least so many characters
    group: int = 0
    least: int = 0
    #: lower-case words of which a text must hold one, in any case; none: every text is searched
    needs: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


RULES = (
    Rule("assign", 1, r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("passw", "secret", "token", "api")),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    Rule("hex", 1, "[0-9a-f]{24,}"),
    Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----", needs=("private key",)),
)
#: Rules whose spans the contract counts.
BASE = ("assign", "access", "hex")


def find(rule: Rule, text: str, lowered: str) -> list[tuple[int, int]]:
    if rule.needs and not any(w in lowered for w in rule.needs):
        return []
    return [m.span() for m in re.finditer(rule.pattern, text) if len(m[rule.group]) >= rule.least]


def _scanned(rules: Sequence[Rule]):
    by_key = {r.key: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = []
            for text, todo in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                text = text.as_py()
                lowered = text.lower()
                found.append([{"rule": k, "start": a, "end": b} for k in todo for a, b in find(by_key[k], text, lowered)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, kind)], names=["blob", "rules", "findings"])

    return run


def _address(text_col: str) -> Column:
    return F.unhex(F.sha2(text_or_empty(text_col), 256))


def entries(spark: SparkSession, ledger: str) -> DataFrame:
    """The rows of a ledger: blob, rules, findings; none if there is no ledger yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _ENTRY)
    return spark.read.schema(_ENTRY).parquet(ledger)


def unseen(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, text_col: str = "text") -> DataFrame:
    """blob, text, todo: each distinct text with the keys of the rules that it has not been searched for."""
    blobs = versions.select(_address(text_col).alias("blob"), text_or_empty(text_col).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    seen = entries(versions.sparkSession, ledger).select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
    todo = F.array(*[F.lit(r.key) for r in rules])
    left = F.array_except(todo, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").select("blob", "text", left.alias("todo")).where(F.size("todo") > 0)


def update(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, text_col: str = "text") -> None:
    """Scans every unseen pair of blob and rule version and appends it to the ledger."""
    unseen(versions, ledger, rules, text_col).mapInArrow(_scanned(rules), _ENTRY).write.mode("append").parquet(ledger)


def findings(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per version: id, blob, findings (start, kind: the rule's number in rules, end; in this order), from the ledger alone."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    paths = versions.select(F.col(id_col).alias("id"), _address(text_col).alias("blob"))
    found = entries(versions.sparkSession, ledger).select("blob", F.explode("findings").alias("f")).select("blob", "f.start", (F.array_position(keys, F.col("f.rule")) - 1).cast("int").alias("kind"), "f.end").where("kind >= 0")
    found = found.groupBy("blob").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("findings"))
    copies = paths.groupBy("blob").agg(F.count("*").alias("copies"))
    out = join_to_groups(paths, copies.join(found, "blob", "left"), "blob", "copies", "left")
    none = F.array().cast("array<struct<start:long,kind:int,`end`:long>>")
    return out.select("id", "blob", F.coalesce("findings", none).alias("findings"))


def scan(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """update(), then findings()."""
    update(versions, ledger, rules, text_col)
    return findings(versions, ledger, rules, id_col, text_col)


def new_ledger(spark: SparkSession) -> str:
    """A ledger in the shared folder that goes when the Python process ends while its session still runs."""
    path = f"{shared_dir(spark)}/quoin-ledger-{uuid.uuid4().hex}"
    _written.append((weakref.ref(spark), path))
    return path


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(r.name) for r in RULES])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"), new_ledger(spark))
    counts = [_count(i).alias(f"n_{name}") for i, name in enumerate(BASE)]
    base = F.filter("findings", lambda x: x["kind"] < len(BASE))
    return out.select(F.col("id").alias("doc_id"), *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("findings")).alias("spans"))


SQL = r"""
WITH k(kind, name, pattern) AS (
  VALUES (0, 'assign', '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'),
         (1, 'access', 'AKIA[A-Z0-9]+'), (2, 'hex', '[0-9a-f]+'), (3, 'pem', '-----BEGIN [A-Z ]*PRIVATE KEY-----[^-]*-----END [A-Z ]*PRIVATE KEY-----')
), d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), m AS (
  SELECT r, kind, name, regexp_extract_all(text, pattern) AS w, string_split_regex(text, pattern) AS p FROM d, k WHERE kind <> 2 OR regexp_matches(text, '[0-9a-f]{24}')
), x AS (
  SELECT r, kind, name, unnest(w) AS what, unnest(list_transform(w, lambda z: length(z))) AS n, unnest(list_transform(p[1:len(w)], lambda z: length(z))) AS gap, generate_subscripts(w, 1) AS i FROM m WHERE len(w) > 0
), s AS (
  SELECT *, CAST(sum(gap + n) OVER (PARTITION BY r, kind ORDER BY i) AS BIGINT) AS stop FROM x
), v AS (
  SELECT *, stop - n AS start, concat_ws(':', name, stop - n, stop) AS span FROM s
  WHERE CASE kind WHEN 0 THEN length(regexp_extract(what, '^[^"'':= ]+["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6 WHEN 1 THEN n >= 20 WHEN 2 THEN n >= 24 ELSE true END
)
SELECT d.doc_id, count(span) FILTER (kind = 0) AS n_assign, count(span) FILTER (kind = 1) AS n_access, count(span) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN v ON d.r = v.r GROUP BY d.r, d.doc_id
"""
