"""Near-duplicates by SimHash fingerprints and exact Jaccard similarity of word shingles, for the pipeline.

Texts link if the sets of their shingles (A-Z lower-cased, `shingle` words each) have Jaccard similarity `least` or more; shingles
are compared by 64-bit hashes. Which pairs to compare: first those whose SimHash fingerprints, of the sets, differ in few bits, which
meet in blocks of bits and are told apart by pivot distances (simhash_dedup.links). Those are the pairs of about 0.95 and more. SimHash
can't reach down to 0.8 alone: the pairs differ in about 10 of 64 bits, 16 and more at times, where blocks of bits that all such
pairs agree on hold 4 bits, so that nearly all pairs of texts would meet. So min-hashes in BANDS bands of ROWS give the pairs that
are not linked by a path of close fingerprints. A pair at 0.8 shares no band with a probability of (1 - 0.8**4)**32 = 5e-8, a
closer pair with a smaller one.

Equal sets meet first and are one node from there on. In band buckets of more than SMALL nodes, the nodes that most such buckets
hold, usually the text that others are copies of, are verified against all others first, with the pairs of close fingerprints. After that every bucket gives all its
pairs whose sizes allow the similarity and that are not linked by a path yet. So a large group of copies gives a few pairs a
copy, and no pair goes unseen. Buckets of more than BLOCK nodes are dealt to blocks, and each pair of blocks is a task's work.

Texts that merely share a common passage meet in buckets too, so a sketch of each set goes along. Of a set of up to SKETCH
shingles it is 16 bits of each shingle's hash, which bound the shared shingles of two sets from above: no similar pair is lost.
Of a larger set it holds the shingles whose hashes end in `level` zero bits, a half of them for each level. Two sets are compared at the higher of
their levels, where the shingles in either are a random sample of their union, so that the shared ones among them are binomial:
pairs pass down to six standard deviations of that below the similarity, which a similar pair misses with a probability of
about 1e-9 at any length. Pairs are verified by the sets, which are read again for nodes of such pairs only.

Defined results: null and blank texts have the empty set and are copies of each other; texts of fewer words than a shingle are
one shingle; rows that repeat an id are rows of their own; a null id never names a component unless all ids in it are null; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .common import join_to_groups, map_texts, materialize, shuffle_partitions
from .components import components
from .simhash_dedup import links as close_fingerprints, simhash
from .words import hash_spans, mix64, pieces, window_hashes, word_spans

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 32, 4
#: Sets of up to so many shingles go along whole, as 16 bits of each hash; of larger ones a half, a quarter and so on.
SKETCH, DEVIATIONS = 256, 6
#: Bytes of text that are hashed at a time; what a worker has taken for that it may keep.
PIECE = 1 << 18
#: A larger bucket is compared with HUBS of its nodes first.
SMALL, HUBS = 16, 4
#: Nodes of a bucket that one task compares with as many.
BLOCK = 1024
_LAST = 2**63 - 1
_RNG = np.random.default_rng(5)
_TIMES = _RNG.integers(0, 2**32, BANDS * ROWS, np.uint32) | np.uint32(1)
_PLUS = _RNG.integers(0, 2**32, BANDS * ROWS, np.uint32)


def _lowered(column: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, end, lower-cased texts) of pieces of a column."""
    for a, b in pieces(column, PIECE):
        # a copy of the piece: of a slice, ascii_lower gives offsets that do not fit its bytes
        yield a, b, pc.ascii_lower(column.slice(a, b - a).take(pa.array(range(b - a), pa.int64())).cast(pa.large_string()).fill_null(""))


def _sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each lower-cased text."""
    data, starts, ends, row = word_spans(texts)
    words = hash_spans(data, starts, ends)
    h, first = window_hashes(words, row, n)
    edges = np.searchsorted(row[first], np.arange(len(texts) + 1))
    at = np.searchsorted(row, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        a, b = at[i], at[i + 1]
        if 0 < b - a < n:
            out.append(window_hashes(words[a:b], row[a:b], int(b - a))[0])
        else:
            out.append(np.unique(h[edges[i] : edges[i + 1]]))
    return out


def _level(n: np.ndarray) -> np.ndarray:
    """How often a sketch of n shingles is halved."""
    return np.maximum(np.ceil(np.log2(np.maximum(n, 1) / SKETCH)), 0).astype(np.int64)


def _sketch(shingles: np.ndarray) -> bytes:
    """Of each hash that ends in level zero bits: 15 bits, then the bit that the next level looks at."""
    level = np.uint64(_level(np.array(len(shingles))))
    h = shingles[shingles & ((np.uint64(1) << level) - np.uint64(1)) == 0]
    return (((h >> np.uint64(48)) << np.uint64(1)) | ((h >> level) & np.uint64(1))).astype(np.uint16).tobytes()


def _bands(sets: list[np.ndarray]) -> np.ndarray:
    """The band keys of each set that isn't empty."""
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(size) - size
    least = np.empty((len(sets), BANDS * ROWS), np.uint64)
    for k in range(BANDS * ROWS):
        least[:, k] = np.minimum.reduceat(flat * _TIMES[k] + _PLUS[k], starts)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sets), BANDS)).copy()
    for k in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + least[:, k::ROWS] + np.uint64(1))
    return key.view(np.int64)


def _digest(x: np.ndarray) -> bytes:
    return hashlib.md5(x.tobytes()).digest()


def _prints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _lowered(batch.column(1)):
                part, sets = batch.slice(a, b - a), _sets(texts, n)
                some = [i for i, x in enumerate(sets) if len(x)]
                keys: list = [[]] * len(sets)
                sketches: list = [None] * len(sets)
                if some:
                    for i, k in zip(some, _bands([sets[i] for i in some]), strict=True):
                        keys[i], sketches[i] = k, _sketch(sets[i])
                count = np.fromiter(map(len, sets), np.int64, len(sets))
                fp = simhash(np.concatenate(sets), count)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([_digest(x) for x in sets], pa.binary()), pa.array(count), pa.array(fp), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["doc_id", "row", "digest", "n", "fp", "bands", "sketch"])

    return run


def _shingles(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in _lowered(batch.column(0)):
                sets = _sets(texts, n)
                yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in sets], pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], names=["digest", "shingles"])

    return run


def _similar(x: str, y: str, least: float) -> Column:
    """Whether two arrays of distinct shingles are similar."""
    same = F.size(F.array_intersect(x, y))
    return same >= F.lit(least) * (F.size(x) + F.size(y) - same) - F.lit(1e-9)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal keys."""
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return first, np.diff(np.append(first, len(key)))


def _by_key(batches: Iterator[pa.RecordBatch], done) -> Iterator[pa.RecordBatch]:
    """done() of tables that hold whole keys, from batches in order of the first column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch.column(0).to_numpy()
        at = int(np.flatnonzero(key != key[-1]).max(initial=-1)) + 1
        if held and (at or held[-1].column(0)[-1].as_py() != key[0]):
            yield from done(pa.Table.from_batches([*held, batch.slice(0, at)]))
            held = []
        elif at:
            yield from done(pa.Table.from_batches([batch.slice(0, at)]))
        held.append(batch.slice(at))
    if held:
        yield from done(pa.Table.from_batches(held))


def _pairs(least: float):
    """Rows (tile, node, n, part, left, right, sketch) in order of tile to pairs (u, v) of different parts, one left and one right in a tile, that may be similar."""

    def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        key, node, n, part = (rows.column(i).to_numpy() for i in range(4))
        left, right = (rows.column(i).to_numpy() for i in (4, 5))
        parts_ = rows.column(6).to_pylist()
        flat, size = np.frombuffer(b"".join(parts_), np.uint16), np.fromiter((len(x) // 2 for x in parts_), np.int64, len(key))
        even, ends, level = (flat & 1) == 0, np.append(0, np.cumsum(size)), _level(n)
        evens = np.append(0, np.cumsum(even))
        halved = evens[ends[1:]] - evens[ends[:-1]]
        mark, half_mark = np.zeros(1 << 16, bool), np.zeros(1 << 15, bool)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for a, m in zip(*(x.tolist() for x in _runs(key)), strict=True):
            every = np.arange(a, a + m)
            others = every[right[every]]
            for i in every[left[every]]:
                of = others[(part[others] != part[i]) & (np.minimum(n[others], n[i]) >= least * np.maximum(n[others], n[i]) - 1e-9)]
                if right[i]:
                    of = of[~left[of] | (of > i)]  # pairs of two that are both are seen once
                if not len(of):
                    continue
                lo, hi = int(of[0]), int(of[-1]) + 1
                seg, own = flat[ends[lo] : ends[hi]], flat[ends[i] : ends[i + 1]]

                def counted(hit: np.ndarray, of: np.ndarray = of, lo: int = lo) -> np.ndarray:
                    both = np.append(0, np.cumsum(hit))
                    return both[ends[of + 1] - ends[lo]] - both[ends[of] - ends[lo]]

                step = level[of] - level[i]
                mark[own] = True
                shared = counted(mark[seg])
                mark[own] = False
                if (step == 1).any():
                    half_mark[own[(own & 1) == 0] >> 1] = True
                    shared = np.where(step == 1, counted(half_mark[seg >> 1]), shared)
                    half_mark[own >> 1] = False
                if (step == -1).any():
                    half_mark[own >> 1] = True
                    shared = np.where(step == -1, counted(half_mark[seg >> 1] & even[ends[lo] : ends[hi]]), shared)
                    half_mark[own >> 1] = False
                total = np.where(step == 1, halved[i], size[i]) + np.where(step == -1, halved[of], size[of])
                union = np.maximum(total - shared, 0)
                slack = np.where((level[i] == 0) & (step == 0), 1e-6, DEVIATIONS * np.sqrt(least * (1 - least) * union))
                of = of[(shared >= least * union - slack) | (np.abs(step) > 1)]  # sketches of levels that far apart can't be compared
                if len(of):
                    out.append((np.maximum(node[of], node[i]), np.minimum(node[of], node[i])))
            if len(out) > 1 << 14:
                yield flush(out)
                out = []
        if out:
            yield flush(out)

    def flush(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        uv = np.unique(np.stack([np.concatenate(x) for x in zip(*out, strict=True)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(uv[0]), pa.array(uv[1])], names=["u", "v"])

    return lambda batches: _by_key(batches, done)


def _tiles(rows: DataFrame) -> DataFrame:
    """rows (key, node, m: size of the bucket) to (tile, node, left, right): every two nodes of a bucket meet in a tile, one left and one right."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    rows = rows.withColumns({"block": F.pmod(F.xxhash64("node"), blocks).cast("int"), "other": F.explode(F.sequence(F.lit(0), blocks - 1))})
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    return rows.select(F.xxhash64("key", lo, hi).alias("tile"), "node", (F.col("block") == lo).alias("left"), (F.col("block") == hi).alias("right"))


def _hub_tiles(rows: DataFrame) -> DataFrame:
    """rows (key, node, m) to (tile, node, left, right): the HUBS nodes of a bucket that are in most of the rows meet all others of it."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    weight = rows.groupBy("node").agg(F.count("*").alias("weight"))
    best = Window.partitionBy("key").orderBy(F.desc("weight"), "node")
    hubs = rows.join(weight, "node").withColumn("at", F.row_number().over(best)).where(F.col("at") <= HUBS)
    hubs = hubs.select("key", "node", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.lit(True).alias("left"), F.lit(False).alias("right"))
    others = rows.select("key", "node", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), F.lit(False).alias("left"), F.lit(True).alias("right"))
    return hubs.unionByName(others).select(F.xxhash64("key", "block").alias("tile"), "node", "left", "right")


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """nodes (node, n, fp) to pairs (u, v) that connect all nodes of fingerprints that are equal or close; sets without a shingle have none."""
    some = nodes.where("n > 0").select("node", "fp")
    distinct = materialize(some.groupBy("fp").agg(F.min("node").alias("rep"), F.count("*").alias("m")))
    equal = join_to_groups(some, distinct, "fp", "m").where("node > rep").select(F.col("node").alias("u"), F.col("rep").alias("v"))
    return equal.unionByName(close_fingerprints(distinct.select("fp", "rep")))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, component_id (the smallest id that links lead to), group (a number of the component), row (row_col's value, if named)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.col(row_col) if row_col else F.lit(None).cast("string")).alias("row"))
    longs, blob = T.LongType(), T.BinaryType()
    schema = T.StructType([T.StructField(c, t) for c, t in (("doc_id", longs), ("row", rows.schema["row"].dataType), ("digest", blob), ("n", longs), ("fp", longs), ("bands", T.ArrayType(longs)), ("sketch", blob))])
    prints = materialize(map_texts(rows, _prints(shingle), schema))
    distinct = prints.groupBy("digest").agg(F.min(F.coalesce("doc_id", F.lit(_LAST))).alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = materialize(distinct.withColumn("node", F.monotonically_increasing_id()))
    parts = max(1, shuffle_partitions(docs.sparkSession))

    def pairs(of: DataFrame) -> DataFrame:
        of = of.join(nodes.select("node", "n", "sketch"), "node").repartition(parts, "tile").sortWithinPartitions("tile")
        return materialize(map_texts(of.select("tile", "node", "n", "part", "left", "right", "sketch"), _pairs(least), "u long, v long"))

    def links(found: DataFrame) -> DataFrame:
        found = materialize(found.distinct())
        ends = found.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        wanted = materialize(nodes.join(ends, "node").select("node", "digest", "rep"))
        texts = rows.join(wanted.select("rep").distinct(), F.coalesce("doc_id", F.lit(_LAST)) == F.col("rep"), "left_semi").select("text")
        sets = map_texts(texts, _shingles(shingle), "digest binary, shingles array<long>").join(wanted.select("digest", "node"), "digest").groupBy("node").agg(F.first("shingles").alias("shingles"))
        sets = materialize(sets)
        both = found.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("y")), "v")
        return materialize(both.where(_similar("x", "y", least)).select("u", "v"))

    keys = nodes.select(F.explode("bands").alias("key"), "node")
    buckets = materialize(keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    shared = materialize(join_to_groups(keys, buckets, "key", "m").select("key", "node", "m"))
    large = shared.where(F.col("m") > SMALL)
    first = _simhash_pairs(nodes)
    if not large.isEmpty():
        first = first.unionByName(pairs(_hub_tiles(large).withColumn("part", F.col("node"))))
    linked = links(first)
    part = components(linked).select("node", F.col("component").alias("hub"))
    dealt = _tiles(shared).join(part, "node", "left").withColumn("part", F.coalesce("hub", "node"))
    linked = linked.unionByName(links(pairs(dealt)))
    named = nodes.join(components(linked), "node", "left").select("digest", "rep", F.coalesce("component", "node").alias("group"))
    least_id = named.groupBy("group").agg(F.min("rep").alias("component_id"))
    named = named.join(least_id, "group").select("digest", "component_id", "group")
    out = prints.select("doc_id", "row", "digest").join(named, "digest")
    out = out.select("doc_id", F.when(F.col("component_id") != _LAST, F.col("component_id")).alias("component_id"), "group", "row")
    return out if row_col else out.drop("row")
