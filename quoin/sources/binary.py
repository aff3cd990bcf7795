"""Binary sources: members of tar archives, IDX tensors, similarity matrices."""

from __future__ import annotations

import gzip
import io
import itertools
import math
import struct
import tarfile
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from quoin.operators import scans


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI as Spark writes it; those that pyarrow knows (local, HDFS, S3, GCS)."""
    scheme, colon, rest = uri.partition(":")
    if not colon:
        return pafs.LocalFileSystem(), uri
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)
    if scheme == "file":
        return pafs.LocalFileSystem(), unquote("/" + rest.lstrip("/"))
    return pafs.FileSystem.from_uri(f"{scheme}:{rest}")


#: Bytes of an archive that one task reads at a time.
RANGE = 1 << 27


def tar_index(spark: SparkSession, path: str, holds: str = "") -> DataFrame:
    """archive, member, offset, size of the files in uncompressed tar archives whose name holds the text. Headers are read, contents are skipped over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                fs, at = _opened(archive)
                found: list[tuple] = []
                with fs.open_input_file(at) as f, tarfile.open(fileobj=f, mode="r:") as tar:
                    for m in tar:
                        if m.isreg() and not m.issparse() and holds in m.name:
                            found.append((archive, m.name, m.offset_data, m.size))
                        tar.members = []  # else the archive's members are all kept
                for lo in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found[lo : lo + 10_000], strict=True), (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["archive", "member", "offset", "size"])

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(run, "archive string, member string, offset long, size long")


def tar_contents(index: DataFrame) -> DataFrame:
    """index with content: every RANGE of an archive is a task's, which seeks to the members that begin in it and reads no more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f = None, None
        for batch in batches:
            for i in range(len(batch)):
                archive, offset, size = (batch.column(c)[i].as_py() for c in (0, 2, 3))
                if archive != name:
                    fs, at = _opened(archive)
                    if f is not None:
                        f.close()
                    name, f = archive, fs.open_input_file(at)
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([f.read_at(size, offset)], pa.binary())], names=["archive", "member", "offset", "size", "content"])
        if f is not None:
            f.close()

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.select("archive", "member", "offset", "size").repartition(parts, "archive", F.floor(F.col("offset") / RANGE)).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(run, "archive string, member string, offset long, size long, content binary")


def tar_members(spark: SparkSession, path: str, holds: str = "", contents: bool = False) -> DataFrame:
    """archive, member, size and content (null unless asked for) of the files in tar archives whose name holds the text."""
    index = tar_index(spark, path, holds)
    out = tar_contents(index) if contents else index.withColumn("content", F.lit(None).cast("binary"))
    return out.select("archive", "member", "size", "content")


def members_in_table(members: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Members joined by file name with rows of the tables beside their archives (a row's archive without folder and ending: `book`); archives without a table are left out."""
    base = F.regexp_replace(F.substring_index("archive", "/", -1), r"\.tar$", "")
    named = members.withColumns({"book": base, "__name": F.substring_index("member", "/", -1)})
    return named.join(rows.withColumnRenamed(name, "__name"), ["book", "__name"]).withColumnRenamed("__name", name)


def _written_whole(fs: pafs.FileSystem, path: str, write) -> None:
    """write(stream) to a file beside path that then takes its place, so that a task that runs twice leaves one whole file."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(part) as out:
        write(out)
    fs.move(part, path)


def _each_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(value of the first column, iterator of the rows with it), from batches in order of that column."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    yield from ((key, group) for key, group in itertools.groupby(rows, key=lambda r: r[0]))


def write_tars(df: DataFrame, archive: str, member: str, content: str, path: str) -> int:
    """Writes a tar archive <path>/<archive>.tar for each value of a column, members in order of their name; gives their number. An archive is one task's, whose rows go by one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(path)
        fs.create_dir(root)
        for name, rows in _each_file(batches):

            def write(out, rows=rows) -> None:
                with tarfile.open(fileobj=out, mode="w|") as tar:
                    for _, inner, data in rows:
                        info = tarfile.TarInfo(inner)
                        info.size = len(data)
                        tar.addfile(info, io.BytesIO(data))

            _written_whole(fs, f"{root}/{name}.tar", write)
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string())], names=["archive"])

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(archive).cast("string").alias("archive"), F.col(member).alias("member"), F.col(content).cast("binary").alias("content"))
    return rows.repartition(parts, "archive").sortWithinPartitions("archive", "member").mapInArrow(run, "archive string").count()


def write_idx(df: DataFrame, order: list[str], values: str, shape: list[int], path: str, per_file: int = 1 << 16, pack: bool = False) -> int:
    """Writes arrays of unsigned bytes of a shape as IDX files <path>/part-00000.idx[.gz] of per_file items each, in order; gives the number of items.

    A header needs the number of its items before they come: rows are numbered over ranges of the order first, so that each
    file's share is known, and then stream into it one after the other.
    """
    numbered, total = scans.numbered(df.select(*order, F.col(values).alias("__values")), order, "__n")
    size = math.prod(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _opened(path)
        fs.create_dir(root)
        for part, rows in _each_file(batches):
            n = min(per_file, total - part * per_file)

            def write(out, rows=rows, n=n) -> None:
                packed = gzip.GzipFile(fileobj=out, mode="wb", mtime=0) if pack else out
                packed.write(struct.pack(f">HBB{1 + len(shape)}I", 0, 8, 1 + len(shape), n, *shape))
                for _, item in rows:
                    data = np.asarray(item)
                    if len(data) != size or (size and (data.min() < 0 or data.max() > 255)):
                        raise ValueError(f"not {size} unsigned bytes")
                    packed.write(data.astype(np.uint8).tobytes())
                if pack:
                    packed.close()

            _written_whole(fs, f"{root}/part-{part:05}.idx{'.gz' if pack else ''}", write)
            yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    part = F.floor((F.col("__n") - 1) / per_file).cast("long").alias("part")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = numbered.select(part, "__n", "__values").repartition(parts, "part").sortWithinPartitions("part", "__n").select("part", "__values")
    return dealt.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def parse_idx(data: bytes) -> np.ndarray:
    """The array of unsigned bytes in an IDX file, packed with gzip or not."""
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    zero, kind, dims = struct.unpack_from(">HBB", data)
    if zero or kind != 8:
        raise ValueError("not an IDX file of unsigned bytes")
    shape = struct.unpack_from(f">{dims}I", data, 4)
    return np.frombuffer(data, np.uint8, offset=4 + 4 * dims).reshape(shape)


def to_idx(array: np.ndarray, pack: bool = False) -> bytes:
    data = struct.pack(f">HBB{array.ndim}I", 0, 8, array.ndim, *array.shape) + np.ascontiguousarray(array, np.uint8).tobytes()
    return gzip.compress(data, mtime=0) if pack else data


def idx_items(spark: SparkSession, path: str) -> DataFrame:
    """file, item, shape, values: one row per entry of the first dimension of IDX files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                array = parse_idx(data)
                for a in range(0, len(array), 1024):
                    part = array[a : a + 1024]
                    yield pd.DataFrame({"file": name, "item": range(a, a + len(part)), "shape": [list(array.shape[1:])] * len(part), "values": [x.reshape(-1).astype(np.int32) for x in part]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, item int, shape array<int>, values array<int>")


def matrix_edges(spark: SparkSession, path: str, least: float) -> DataFrame:
    """i, j, weight: cells i < j of at least the weight of a square .npy matrix."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                matrix = np.load(io.BytesIO(data))
                for i in range(len(matrix)):
                    j = np.flatnonzero(matrix[i, i + 1 :] >= least) + i + 1
                    yield pd.DataFrame({"i": np.full(len(j), i), "j": j, "weight": matrix[i, j].astype(float)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "i long, j long, weight double")


def scored_by(df: DataFrame, model, schema: str) -> DataFrame:
    """The hook for models: model(iterator of pandas frames) gives frames of the schema; one load per task."""
    return df.mapInPandas(model, schema)


def layout_positions(df: DataFrame, column: str) -> DataFrame:
    """node, x, y of a saved layout {node: {x, y}} in JSON."""
    parsed = F.from_json(column, "map<string, struct<x: int, y: int>>")
    return df.select(F.explode(parsed).alias("node", "p")).select("node", "p.x", "p.y")
