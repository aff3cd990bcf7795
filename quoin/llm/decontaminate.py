"""Benchmark decontamination by greedy string tiling with running Karp-Rabin.

Texts of both sides are lower-cased and cut into tokens at white space and ASCII punctuation. Rolling hashes of `seed` tokens
join documents to test items; an item whose shared seeds can't cover `threshold` of it is dropped at once. For the others the
tiling marks, longest first, matches of at least `seed` tokens whose tokens are not marked yet on either side, each checked
token by token, until none is left. The share of an item's tokens under tiles is its coverage, whatever the order of the tiles
in the document, so shuffled passages are caught.

The test side goes to the executors in blocks of at most BLOCK_CHARS of text, each against all documents in a pass
without a shuffle; a benchmark of usual size is one block.

Defined results: null and blank texts match nothing; an item of fewer tokens than a seed matches if all its tokens occur in a
row; items without tokens match nothing; rows that repeat an id are reported each; a null id is reported as null; empty
tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import map_texts, table
from .words import hash_spans, pieces, window_hashes, word_spans

SEED = 5
THRESHOLD = 0.8
#: Characters of test items that are sent to the executors at a time.
BLOCK_CHARS = 1 << 24
#: Bytes of documents that are hashed at a time.
PIECE = 1 << 18

_BREAKS = np.zeros(256, bool)
_BREAKS[[b for b in range(128) if not chr(b).isalnum()]] = True


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return word_spans(pc.utf8_lower(column), _BREAKS)


class Items:
    """Test items with their tokens and an index of their seeds, by seed length."""

    def __init__(self, rows: list[tuple[int, str | None]], seed: int, threshold: float):
        self.ids, self.seed, self.threshold = [r[0] for r in rows], seed, threshold
        data, starts, ends, row = _tokens(pa.array([r[1] for r in rows], pa.string()))
        self.tokens: list[list[bytes]] = [[] for _ in rows]
        blob = data.tobytes()
        for a, b, r in zip(starts.tolist(), ends.tolist(), row.tolist(), strict=True):
            self.tokens[r].append(blob[a:b])
        hashes = hash_spans(data, starts, ends)
        size = np.array([len(t) for t in self.tokens], np.int64)
        first = np.append(0, np.cumsum(size))
        self.index: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in sorted({min(seed, s) for s in size.tolist() if s}):
            h, at = window_hashes(hashes, row, n)
            use = np.minimum(size[row[at]], seed) == n
            h, at = h[use], at[use]
            order = np.argsort(h, kind="stable")
            self.index.append((n, h[order], row[at][order], (at - first[row[at]])[order]))

    def tiles(self, words: list[bytes], item: int, at: np.ndarray, of: np.ndarray, n: int) -> list[tuple[int, int, int]]:
        """(place in the document, place in the item, length) of tiles, from seeds that start at `at` and `of`."""
        pattern = self.tokens[item]
        order = np.lexsort((at, at - of))
        at, of = at[order], of[order]
        new = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(at - of) != 0)))
        length = np.diff(np.append(new, len(at))) + n - 1
        heap = [(-k, a, b) for k, a, b in zip(length.tolist(), at[new].tolist(), of[new].tolist(), strict=True)]
        heapq.heapify(heap)
        done_words, done, out = set(), [False] * len(pattern), []
        while heap:
            k, a, b = heapq.heappop(heap)
            free = [not done[b + i] and a + i not in done_words and words[a + i] == pattern[b + i] for i in range(-k)]
            if all(free):
                out.append((a, b, -k))
                done[b : b - k] = [True] * -k
                done_words.update(range(a, a - k))
                continue
            i = 0
            while i < -k:  # what is still free of it comes up again by its length
                j = i
                while j < -k and free[j]:
                    j += 1
                if j - i >= n:
                    heapq.heappush(heap, (i - j, a + i, b + i))
                i = j + 1
        return out

    def match(self, column: pa.Array) -> Iterator[tuple[int, int, float, list]]:
        """(row, item, coverage, tiles) of items covered to the threshold."""
        data, starts, ends, row = _tokens(column)
        hashes, blob = hash_spans(data, starts, ends), None
        begin = np.searchsorted(row, np.arange(len(column) + 1))
        for n, known, items, places in self.index:
            h, at = window_hashes(hashes, row, n)
            lo = np.searchsorted(known, h)
            found = np.flatnonzero(known[np.minimum(lo, len(known) - 1)] == h)
            if not len(found):
                continue
            count = np.searchsorted(known, h[found], "right") - lo[found]
            seed = np.repeat(lo[found] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
            at = np.repeat(at[found], count)
            item, place, r = items[seed], places[seed], row[at]
            order = np.lexsort((item, r))
            item, place, r, at = item[order], place[order], r[order], at[order]
            cut = np.flatnonzero(np.append(True, (np.diff(r) != 0) | (np.diff(item) != 0)))
            for a, b in zip(cut.tolist(), np.append(cut[1:], len(r)).tolist(), strict=True):
                pattern = self.tokens[item[a]]
                most = np.zeros(len(pattern), bool)
                for k in range(n):
                    most[place[a:b] + k] = True
                if most.mean() < self.threshold:
                    continue
                blob = blob or data.tobytes()
                lo_, hi_ = begin[r[a]], begin[r[a] + 1]
                words = [blob[x:y] for x, y in zip(starts[lo_:hi_].tolist(), ends[lo_:hi_].tolist(), strict=True)]
                tiles = self.tiles(words, int(item[a]), at[a:b] - lo_, place[a:b], n)
                coverage = sum(t[2] for t in tiles) / len(pattern)
                if coverage >= self.threshold:
                    yield int(r[a]), int(item[a]), coverage, tiles


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_CHARS))
    for k in range(n):
        part = benchmark.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k) if n > 1 else benchmark
        yield sorted(((r.item, r.text) for r in part.toLocalIterator()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and test item that it covers: doc_id, item_id, coverage, tiles (doc_start, item_start, n) in tokens."""
    out = None
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    for block in _blocks(benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text"))):
        found = map_texts(rows, _pairs(Items(block, seed, threshold)), "doc_id long, item_id long, coverage double, tiles array<struct<doc_start:int,item_start:int,n:int>>")
        out = found if out is None else out.unionByName(found)
    return out


def _pairs(items: Items):
    tile = pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("n", pa.int32())])
    fields = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(tile))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0), []
            for a, b in pieces(batch.column(1), PIECE):
                for r, item, coverage, tiles in items.match(batch.column(1).slice(a, b - a)):
                    rows.append((ids[a + r].as_py(), items.ids[item], coverage, [dict(zip(("doc_start", "item_start", "n"), t, strict=True)) for t in tiles]))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(fields)], schema=fields)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, threshold: float = THRESHOLD, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs without the rows that cover any test item, all columns as they are."""
    at = docs.columns.index(text_col)
    fields = T.StructType(list(docs.schema.fields))
    for block in _blocks(benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text).alias("text"))):
        items = Items(block, seed, threshold)

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for a, b in pieces(batch.column(at), PIECE):
                    for found in items.match(batch.column(at).slice(a, b - a)):
                        keep[a + found[0]] = False
                yield batch.filter(pa.array(keep))

        docs = map_texts(docs, run, fields)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), F.size("tiles").cast("long").alias("n_tiles"))
