"""Whitening of embeddings by a tall-skinny QR decomposition.

Entries become integers x = floor(1024 * c) + 100000, so that counts and sums are exact whatever the partitioning. Rows are centred
as (n * x - S) / n, where n * x - S is exact too; every partition keeps one triangular factor R of its centred rows, and
the factors are merged FAN at a time until one is left. Its singular values and right vectors are those of all centred
rows: no covariance is formed. The driver sees the sums, the last R and one covariance of at most COMPONENTS columns.

Defined results: rows whose vector is null, empty or has null or non-finite entries are left out, and so are vectors of another
length than most (of two lengths equally frequent, the longer counts); entries past 2**62 count as 2**62; rows that repeat
an id are rows of their own, null ids stay; a deviation that no long holds is null. A component without variance (all
of them where all vectors are equal) has null whitened values and counts for nothing in identity_error, which is null if
no component has any. No row left gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import discard, materialize, table

SCALE, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Triangular factors that one task merges, one after the other.
FAN = 16
#: Rows that are decomposed together with the factor so far.
_ROWS = 2048
#: Singular values below this share of the largest are rounding.
_NO_VARIANCE = 1e-12


def usable(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, vec of the rows whose vector has finite entries only."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    bad = F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.where((F.size("vec") > 0) & ~bad)


def _integers(vec: pa.Array, d: int) -> np.ndarray:
    c = vec.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    return np.clip(np.floor(SCALE * c), -(2.0**62), 2.0**62).astype(np.int64) + OFFSET


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length of vector: count, and per dimension the sums of the upper and lower halves of x."""
    total: dict[int, list] = {}
    for batch in batches:
        size = pa.compute.list_value_length(batch.column(0)).to_numpy()
        for d in np.unique(size).tolist():
            x = _integers(batch.column(0).filter(pa.array(size == d)), d)
            n, high, low = total.get(d, (0, np.zeros(d, np.int64), np.zeros(d, np.int64)))
            total[d] = [n + len(x), high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0)]
    for d, (n, high, low) in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], names=["d", "dim", "n", "high", "low"])


@dataclass
class Whitening:
    n: int
    #: exact sums of x by dimension
    sums: list[int]
    #: unit right singular vectors as columns, by falling variance
    vectors: np.ndarray
    variances: np.ndarray
    trace: float

    def __post_init__(self) -> None:
        self._high = max(map(abs, self.sums))

    def deviations(self, vec: pa.Array) -> np.ndarray:
        """n * x - S, exact: of long where they fit, else of Python's integers."""
        x = _integers(vec, len(self.sums))
        if self.n * int(np.abs(x).max(initial=0)) + self._high < 2**62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def project(self, deviations: np.ndarray) -> np.ndarray:
        """Whitened values, a column for each component; NaN without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return (deviations.astype(np.float64) / self.n) @ self.vectors / np.where(self.variances > 0, np.sqrt(self.variances), np.nan)


def _squares(y: np.ndarray) -> list[int | None]:
    """Exact sums of squares by row; None where no long holds one."""
    near = (y.astype(np.float64) ** 2).sum(axis=1)
    fits = near < 2.0**62
    out: list[int | None] = [None] * len(y)
    if fits.any():
        for i, v in zip(np.flatnonzero(fits).tolist(), (y[fits].astype(np.int64) ** 2).sum(axis=1).tolist(), strict=True):
            out[i] = v
    for i in np.flatnonzero(~fits & (near < 2.0**63 * 1.001)).tolist():
        v = sum(int(e) ** 2 for e in y[i])
        out[i] = v if v < 2**63 else None
    return out


def _merged(merge: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """Rows (slot, block) in order of slot to one row per slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held = None, None
        for batch in batches:
            for s, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = np.frombuffer(block.as_buffer(), np.float64)
                if slot is not None and s != slot:
                    yield pa.RecordBatch.from_arrays([pa.array([slot]), pa.array([held.tobytes()], pa.binary())], names=["slot", "block"])
                    held = None
                slot, held = s, b if held is None else merge(held, b)
        if slot is not None:
            yield pa.RecordBatch.from_arrays([pa.array([slot]), pa.array([held.tobytes()], pa.binary())], names=["slot", "block"])

    return run


def tree(blocks: DataFrame, merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray | None:
    """blocks: slot long, block binary (doubles). All blocks merged into one, FAN at a time; None of no blocks."""
    blocks = materialize(blocks)
    most = blocks.agg(F.max("slot")).first()[0]
    if most is None:
        return None
    now = blocks
    while most:
        most //= FAN
        now = now.select(F.floor(F.col("slot") / FAN).alias("slot"), F.col("slot").alias("__was"), "block").repartition(most + 1, "slot").sortWithinPartitions("slot", "__was")
        now = now.select("slot", "block").mapInArrow(_merged(merge), "slot long, block binary")
    block = now.first()["block"]
    discard(blocks)
    return np.frombuffer(bytes(block), np.float64)


def _triangle(rows: np.ndarray) -> np.ndarray:
    """R of rows, with rows of zeros up to a square."""
    r = np.linalg.qr(rows, mode="r")
    return np.vstack([r, np.zeros((rows.shape[1] - len(r), rows.shape[1]))]) if len(r) < rows.shape[1] else r


def _factors(model: Whitening):
    d = len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, r = None, np.zeros((0, d))
        for batch in batches:
            for at in range(0, len(batch), _ROWS):
                part = batch.slice(at, _ROWS)
                slot = part.column(0)[0].as_py()
                r = _triangle(np.vstack([r, model.deviations(part.column(1)).astype(np.float64) / model.n]))
        if slot is not None:
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([r.tobytes()], pa.binary())], names=["slot", "block"])

    return run


def _moments(model: Whitening):
    """Per partition: count, means and centred products of the components with variance, as one block."""
    some = np.flatnonzero(model.variances > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, held = None, None
        for batch in batches:
            if len(batch):
                slot = batch.column(0)[0].as_py()
                w = model.project(model.deviations(batch.column(1)))[:, some]
                mean = w.mean(axis=0)
                block = np.concatenate([[len(w)], mean, ((w - mean).T @ (w - mean)).ravel()])
                held = block if held is None else _pooled(held, block)
        if slot is not None:
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int64()), pa.array([held.tobytes()], pa.binary())], names=["slot", "block"])

    return run


def _pooled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of two sets of rows as those of their union, still centred before multiplying."""
    k = int((np.sqrt(4 * len(a) - 3) - 1) / 2)
    n, step = a[0] + b[0], b[1 : k + 1] - a[1 : k + 1]
    return np.concatenate([[n], a[1 : k + 1] + step * b[0] / n, a[k + 1 :] + b[k + 1 :] + np.outer(step, step).ravel() * a[0] * b[0] / n])


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """rows: as usable() gives them. None if there are none."""
    parts = rows.select("vec").mapInArrow(_sums, "d long, dim long, n long, high long, low long")
    whole = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    per = parts.groupBy("d", "dim").agg(F.sum("n").alias("n"), whole("high"), whole("low"))
    length = per.where("dim = 0").orderBy(F.desc("n"), F.desc("d")).select("d", "n").first()
    if length is None:
        return None
    sums = [int(r.high) * 2**32 + int(r.low) for r in per.where(F.col("d") == length.d).orderBy("dim").collect()]  # one row a dimension
    model = Whitening(length.n, sums, np.zeros((length.d, 0)), np.zeros(0), 0.0)
    slotted = of_length(rows, length.d).select(F.spark_partition_id().cast("long").alias("slot"), "vec")
    d = length.d
    r = tree(slotted.mapInArrow(_factors(model), "slot long, block binary"), lambda a, b: _triangle(np.vstack([a.reshape(-1, d), b.reshape(-1, d)])).ravel())
    _, s, vt = np.linalg.svd(r.reshape(-1, d))
    vt *= np.where(vt[np.arange(d), np.abs(vt).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    s = np.where(s > s[0] * _NO_VARIANCE, s, 0.0)
    variances = s**2 / model.n
    return Whitening(model.n, sums, vt[:components].T.copy(), variances[:components], float(variances.sum()))


def of_length(rows: DataFrame, d: int) -> DataFrame:
    return rows.where(F.size("vec") == d)


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """The largest absolute difference of an entry of the whitened rows' covariance from the identity."""
    if not (model.variances > 0).any():
        return None
    slotted = of_length(rows, len(model.sums)).select(F.spark_partition_id().cast("long").alias("slot"), "vec")
    block = tree(slotted.mapInArrow(_moments(model), "slot long, block binary"), _pooled)
    k = int((model.variances > 0).sum())
    return float(np.abs(block[k + 1 :].reshape(k, k) / block[0] - np.eye(k)).max())


def _whitened(model: Whitening, error: float | None):
    k = len(model.variances)
    explained = [float(v / model.trace) if model.trace else 0.0 for v in model.variances]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = len(batch)
            y = model.deviations(batch.column(1))
            w = model.project(y).ravel()
            cols = [
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                pa.array(_squares(y), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(w, mask=np.isnan(w)), pa.array(np.tile(explained, m)), pa.array([error] * (m * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component (numbered from 1): id, component, n, deviation, whitened, explained, identity_error."""
    rows = usable(df, id_col, vec_col)
    kinds = [("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())]
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *[T.StructField(c, t) for c, t in kinds]])
    model = fit(rows, components)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    return of_length(rows, len(model.sums)).mapInArrow(_whitened(model, identity_error(rows, model)), schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
