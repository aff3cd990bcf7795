"""The corpus pipeline: documents to a mix of sources, each stage written as Parquet and read again by the next.

Stages, in this order: toxicity (documents scored at or above its threshold go), line dedup, near-dedup (of each group of
documents linked by five-word Jaccard similarity of 0.8 or more, that with the smallest id stays; pairs come from SimHash fingerprints and min-hashes), benchmark decontamination, mixing sources to target weights.

Defined results: every stage takes nulls, empty texts and empty tables as its operator does. A null text is not toxic, has no
lines to lose, is a copy of other empty texts and holds no benchmark item. Of each group of near copies one row stays, that
of the smallest id, null last; of rows that repeat that id, the first of the first file. All columns of documents, extra ones
too and whatever their names, go through every stage but the last, which gives one row per document left with its share of the mix.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from quoin.llm import decontaminate as _decontaminate, line_dedup as _line_dedup, mixing as _mixing, near_dedup as _near_dedup, toxicity as _toxicity
from quoin.llm.common import materialize, table


def _unused(docs: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    name = _unused(docs, "score")
    scored = _toxicity.score(docs, _toxicity.train(docs, labels), out=name)
    return scored.where(F.col(name) < _toxicity.THRESHOLD).drop(name)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _line_dedup.line_dedup(docs)


def _placed(docs: DataFrame, name: str) -> DataFrame:
    """docs with each row's file and place in it, which stay the same however often docs is read."""
    place = docs.metadataColumn("_metadata")
    return docs.withColumn(name, F.struct(place["file_path"].alias("file"), place["row_index"].alias("at")))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    name = _unused(docs, "place")
    try:
        rows = _placed(docs, name)
    except AnalysisException:  # docs isn't read from files
        rows = _placed(materialize(docs), name)
    groups = _near_dedup.near_duplicates(rows, row_col=name)
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), F.col("row").alias("row"))).alias("first")
    kept = groups.groupBy("group").agg(first).select(F.col("first.row").alias("kept"))
    return rows.join(kept, rows[name] == kept["kept"], "left_semi").drop(name)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _mixing.mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixing", mixing),
]

#: Trained scores and fingerprints have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
