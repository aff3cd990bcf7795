"""SimHash near-deduplication with pivot distance tables.

Fingerprints: A-Z lower-cased, words, shingles of n words with repeats; bit b is set if it is set in over half the
shingles' XXH64 (seed 42). Fingerprints link at `distance` or fewer differing bits.

Equal fingerprints meet first, by map-side aggregation, so a group of copies is one fingerprint from there on. Which pairs to
compare: of the 64 bits in so many blocks, two fingerprints within the distance agree on all blocks but `distance`, so each
is dealt to every such choice of blocks, and only fingerprints of one bucket are compared (pivots alone would leave the number
of pairs quadratic). There are as many blocks as make a bucket's bits outnumber the fingerprints, so buckets stay small
at every size. Within a bucket the pivot table decides: the distances to a few reference fingerprints are computed once per
fingerprint; a pair whose largest coordinate difference exceeds the distance can't link and is discarded; survivors are
verified by their differing bits. A bucket yields the edges of a spanning forest by breadth-first search, never all its
pairs. Buckets of over SPLIT fingerprints are divided again, exactly, on finer blocks. A bucket holds distinct fingerprints,
16 bytes each, however many documents share them. Linked fingerprints go through components().

Defined results: null and blank texts have fingerprint zero, which links like any other; texts of fewer words than a shingle
are one shingle; rows that repeat an id are rows of their own; a null id never names a component unless all ids in it are
null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import join_to_groups, materialize, shuffle_partitions, table, tidy
from .components import components
from .words import pieces

SHINGLE = 4
DISTANCE = 4
#: Reference fingerprints: those with the smallest hashes.
PIVOTS = 16
#: A larger bucket is divided again.
SPLIT = 4096
_LAST = 2**63 - 1


def _hashes(text: str, n: int) -> list[int]:
    words = text.encode().lower().split()
    if not words:
        return []
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return [h(joined, 42)]
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    return [h(joined[a:b], 42) for a, b in zip((end - size).tolist(), end[n - 1 :].tolist(), strict=False)]


def simhash(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The fingerprint of each text: h has the hashes of all texts' shingles, count how many each text has."""
    fp, some = np.zeros(len(count), np.uint64), np.flatnonzero(count)
    edges = np.append(0, np.cumsum(count[some]))
    lo = 0
    while lo < len(some):  # about 2**17 shingles at a time, or one text
        hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + (1 << 17), "right")) - 1)
        bits = np.unpackbits(h[edges[lo] : edges[hi]].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, edges[lo:hi] - edges[lo], axis=0, dtype=np.int64)
        fp[some[lo:hi]] = np.packbits(2 * ones > count[some[lo:hi], None], axis=1, bitorder="little").reshape(-1).view(np.uint64)
        lo = hi
    return fp.view(np.int64)


def fingerprints(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(1)):
                part = batch.slice(a, b - a)
                each = [_hashes(x or "", n) for x in part.column(1).to_pylist()]
                count = np.fromiter(map(len, each), np.int64, len(each))
                h = np.fromiter((x for xs in each for x in xs), np.uint64, int(count.sum()))
                del each
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(simhash(h, count))], names=["doc_id", "fp"])

    return tidy(run)


def _cuts(blocks: int) -> list[int]:
    """The mask of each of so many blocks of the 64 bits."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]


def _masks(blocks: int, distance: int) -> list[int]:
    """Of each choice of blocks - distance blocks: fingerprints within the distance agree on one of these masks."""
    return [sum(x) for x in combinations(_cuts(blocks), blocks - distance)]


def _blocks(n: int, distance: int) -> int:
    """Blocks of the 64 bits: at least distance + 2, more while the bits of a choice could not tell n fingerprints apart, up to twice the distance."""
    blocks = distance + 2
    while blocks < 2 * distance and 64 * (blocks - distance) // blocks < n.bit_length():
        blocks += 1
    return blocks


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class _Linker:
    """Spanning edges of the fingerprints of one bucket that link."""

    def __init__(self, pivots: list[int], distance: int):
        self.pivots, self.distance = np.array(pivots, np.uint64), distance
        self.finer = [np.uint64(m) for m in _masks(2 * distance, distance)]

    def table(self, fp: np.ndarray) -> np.ndarray:
        return np.bitwise_count(fp[:, None] ^ self.pivots).astype(np.int8)

    def near(self, fp: np.ndarray, t: np.ndarray, i: int, of: np.ndarray) -> np.ndarray:
        """Which of the indices `of` link with i: by pivots, then by bits."""
        of = of[np.abs(t[of] - t[i]).max(axis=1) <= self.distance] if t.shape[1] else of
        return of[np.bitwise_count(fp[of] ^ fp[i]) <= self.distance]

    def link(self, fp: np.ndarray, split: bool = True) -> list[tuple[int, int]]:
        if split and len(fp) > SPLIT:
            return self.divide(fp)
        t, out, rest = self.table(fp), [], np.arange(len(fp))
        while len(rest):
            queue, rest = [int(rest[0])], rest[1:]
            while queue and len(rest):
                i = queue.pop()
                found = self.near(fp, t, i, rest)
                if len(found):
                    out += [(i, j) for j in found.tolist()]
                    queue += found.tolist()
                    left = np.ones(len(fp), bool)
                    left[found] = False
                    rest = rest[left[rest]]
        return out

    def divide(self, fp: np.ndarray) -> list[tuple[int, int]]:
        out: set[tuple[int, int]] = set()
        for mask in self.finer:
            key = fp & mask
            order = np.argsort(key)
            run = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
            for a, b in zip(run, np.append(run[1:], len(fp)), strict=True):
                if b - a > 1:
                    at = order[a:b]
                    out.update((int(at[i]), int(at[j])) for i, j in self.link(fp[at], split=False))
        return list(out)


def _edges(pivots: list[int], distance: int):
    """Rows (key, fp, rep) in order of key to edges between reps."""

    def of(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, linker: _Linker) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        pair = first[size == 2]  # most buckets that hold more than one
        if len(pair):
            t = linker.table(fp[pair]), linker.table(fp[pair + 1])
            near = (np.abs(t[0] - t[1]).max(axis=1, initial=0) <= distance) & (np.bitwise_count(fp[pair] ^ fp[pair + 1]) <= distance)
            u.append(rep[pair[near]]), v.append(rep[pair[near] + 1])
        for a, n in zip(first[size > 2], size[size > 2], strict=True):
            found = np.array(linker.link(fp[a : a + n]), np.int64).reshape(-1, 2)
            u.append(rep[a + found[:, 0]]), v.append(rep[a + found[:, 1]])
        u, v = np.concatenate(u), np.concatenate(v)
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linker, held = _Linker(pivots, distance), []
        for batch in batches:
            if not len(batch):
                continue
            now = [batch.column(i).to_numpy() for i in range(3)]
            if held and held[0][0][-1] != now[0][0]:
                yield from of(*(np.concatenate(x) for x in zip(*held, strict=True)), linker)
                held = []
            at = int(np.searchsorted(now[0], now[0][-1]))
            if at and (held or at < len(now[0])):
                held.append([x[:at] for x in now])
                yield from of(*(np.concatenate(x) for x in zip(*held, strict=True)), linker)
                held = []
            held.append([x[at:] for x in now])
        if held:
            yield from of(*(np.concatenate(x) for x in zip(*held, strict=True)), linker)

    def unsigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(b.column(1).to_numpy().view(np.uint64)), b.column(2)], names=["key", "fp", "rep"])

    return tidy(lambda batches: run(unsigned(batches)))


def links(distinct: DataFrame, distance: int = DISTANCE, pivots: int = PIVOTS) -> DataFrame:
    """distinct: fp, rep (a number of it), one row a fingerprint, written already. Pairs (u, v) of numbers that connect all fingerprints within the distance; a pair may come twice."""
    chosen = [x.fp % (1 << 64) for x in distinct.orderBy(F.xxhash64("fp"), "fp").limit(pivots).collect()]
    masks = _masks(_blocks(distinct.count(), distance), distance)
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(masks)])
    dealt = distinct.select(F.explode(keys).alias("key"), "fp", "rep")
    return dealt.repartition(shuffle_partitions(distinct.sparkSession), "key").sortWithinPartitions("key").mapInArrow(_edges(chosen, distance), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, pivots: int = PIVOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (the smallest id that links lead to)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    prints = materialize(rows.mapInArrow(fingerprints(shingle), "doc_id long, fp long"))
    distinct = materialize(prints.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(_LAST))).alias("rep"), F.count("*").alias("copies")))
    found = components(links(distinct, distance, pivots).distinct())
    named = materialize(distinct.join(found, F.col("rep") == F.col("node"), "left").select("fp", "copies", F.coalesce("component", "rep").alias("component_id")))
    out = join_to_groups(prints, named, "fp", "copies")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("component_id") != _LAST, F.col("component_id")).alias("component_id"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
