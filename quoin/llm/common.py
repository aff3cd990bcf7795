"""Helpers shared by the corpus operators: table access, shared storage, word and text expressions."""

from __future__ import annotations

import atexit
import ctypes
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

#: The white space that separates words, as a regex class body: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

_written: list[tuple[weakref.ref, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session in one process gets a temporary one; a cluster is an error."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quoin-checkpoint-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage is cut, and every executor can read it again.

    The folder goes when the Python process ends while its session still runs.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quoin-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _written.append((weakref.ref(spark), path))
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote for df; only for frames that nothing reads any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/quoin-" in path:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for ref, path in _written:
        spark = ref()
        if spark is not None and spark.sparkContext._jsc is not None:
            _delete(spark, path)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow; memory that it has freed goes back to the system when it ends, as its Python worker lives on and would keep it."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
            if trim is not None:
                trim(0)

    return whole


#: Bytes of rows that go to a Python worker at a time.
BATCH_BYTES = 1 << 21


def map_texts(df: DataFrame, run: Callable[[Iterator], Iterator], schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow of a tidy run, whose batches end after BATCH_BYTES or one row: by Spark's defaults a batch holds 10,000 texts of up to 64 MB, of which JVM and worker each keep some copies.

    Spark looks at this setting when the result is run, so it stays on the session; a smaller one is kept.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    n, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", conf.get(name).strip().lower()).groups()
    if int(n) << 10 * " kmgtp".index(unit or " ") > BATCH_BYTES:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(tidy(run), schema)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def n_words(text: Column) -> Column:
    """Number of runs of non-space characters; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions_for(df: DataFrame, part_bytes: int = 1 << 25) -> int:
    """As many partitions as the session's setting says, or more where the plan's input is larger than part_bytes for each."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    least = shuffle_partitions(df.sparkSession)
    return max(least, -(-size // part_bytes)) if size < 1 << 60 else least  # what has no known size reports nearly 2**63


#: Words of 64 bits in a bitmap: half a MB, whatever the size of the data.
BITMAP_WORDS = 1 << 16


def bitmap(hashes: DataFrame) -> DataFrame:
    """One row, one array: a bit for each value of the only column of hashes (long), modulo its size."""
    spark, n = hashes.sparkSession, BITMAP_WORDS * 64
    bit = hashes.select(F.pmod(F.col(hashes.columns[0]), F.lit(n)).alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 AS int))")).alias("word"))
    every = spark.range(BITMAP_WORDS).join(words, F.col("id") == F.col("at"), "left")
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0).cast("long")).alias("word")))), lambda x: x["word"]).alias("bits"))


def may_be_in(df: DataFrame, hash_col: str, bits: DataFrame, negate: bool = False) -> DataFrame:
    """Rows of df whose hash_col may be among those of the bitmap; negate: the rows that surely are not. A filter without a shuffle, never the answer itself."""
    at = F.pmod(F.col(hash_col), F.lit(BITMAP_WORDS * 64))
    word = F.get(F.col("bits"), F.shiftright(at, 6).cast("int"))
    is_set = F.getbit(word, at.bitwiseAND(63).cast("int")) == 1
    # one row of BITMAP_WORDS * 8 bytes
    return df.join(F.broadcast(bits), ~is_set if negate else is_set, "left_semi")


#: A key that at least one in HOT rows has is joined in SALTS parts; there can't be more than HOT such keys.
HOT, SALTS = 1024, 64


def join_to_groups(rows: DataFrame, groups: DataFrame, key: str, copies: str, how: str = "inner") -> DataFrame:
    """rows joined by key to groups, one row per key with the number of rows that have it; rows of hot keys are dealt to several tasks."""
    total = groups.agg(F.sum(copies)).first()[0] or 0
    hot = [r[0] for r in groups.where(F.col(copies) >= max(2, total / HOT)).select(key).collect()]  # at most HOT
    if not hot:
        return rows.join(groups, key, how)
    is_hot = F.col(key).isin(hot)
    salt = F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).otherwise(0)
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("__salt", salt).join(groups.withColumn("__salt", F.explode(salts)), [key, "__salt"], how).drop("__salt")
