"""Substring deduplication by relative Lempel-Ziv parsing over words.

Every document is factored against the blocks of all documents with a smaller id. A window is `window` words in a row. Four steps:

1. Index. Windows are hashed and dealt by hash ranges; a task first joins equal hashes of its own documents and sends on, per
   hash, its smallest document only, as sorted and difference-coded blocks, so a passage that many documents share meets in its
   range once per task. A document whose window has the hash of a smaller one's is told that id, its reference; the
   reference is told which of its windows serve.
2. Factors. Texts meet these notes once. At each place the factor runs on while the following windows have the same
   reference; windows that cross from one factor into the next are looked up as every other, so a repeat that the parse cuts in two
   is still covered. The words of each distinct factor of a task (a claim) and the serving runs of each reference (its blocks) go on.
3. Comparison. Each claim is parsed greedily against the blocks of its reference, by words: the longest match from its start,
   then the longest from `window` - 1 words before that match's end, so that the windows over each boundary are compared too. A
   window that no block holds was claimed by its hash only. References with many claims are split over several tasks.
4. Only if there are such windows (expected from about 10**10 windows on): all windows of these hashes are grouped by their
   words, and the factors of the documents that hold them are mended.

What factors cover are the duplicate spans, and nothing else is removed. So no word goes by a hash alone.

Defined results: null and blank texts have no words; texts shorter than the window lose nothing; a null id counts as
larger than all others; rows that repeat an id are one document for the question which id is smaller; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialize, partitions_for, table
from .words import hash_spans, pieces, window_hashes, word_spans

WINDOW = 13
#: Windows that a task sorts at a time.
RUN = 1 << 22
#: Bytes of text that a task gathers before it sends them on.
GATHER = 1 << 25
#: Bytes of claims on one reference that one task compares.
CLAIMS = 1 << 24
#: Hashes whose windows are told apart by words in one pass over the texts.
APART = 1 << 20
_LAST = 2**63 - 1
_NOTES = "bucket int, n int, docs binary, hashes binary, refs binary"
_BLOCKS = "bucket int, n int, docs binary, hashes binary, refs binary, head binary"
_PARSED = "kind int, row long, key long, doc_id long, text string, factors array<struct<start:int,n:int,ref:long>>, ref long, words binary"
_ROW, _CLAIM, _BLOCK = 0, 1, 2
#: Ids are dealt by (id % _MOD) * _TIMES % _MOD.
_MOD, _TIMES = 2**31 - 1, 48271

_FACTOR = pa.struct([("start", pa.int32()), ("n", pa.int32()), ("ref", pa.int64())])
_NOTE_FIELDS = pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("docs", pa.binary()), ("hashes", pa.binary()), ("refs", pa.binary())])
_TEXT_FIELDS = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("text", pa.large_string())])
_PARSED_FIELDS = pa.schema([("kind", pa.int32()), ("row", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("factors", pa.list_(_FACTOR)), ("ref", pa.int64()), ("words", pa.binary())])


def _pack(values: np.ndarray, width: int) -> bytes:
    planes = np.ascontiguousarray(values.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int, width: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view(np.uint64)


def _width(values: np.ndarray) -> int:
    return max(1, (int(values.max()).bit_length() + 7) // 8)


def _squeeze(ids: np.ndarray) -> bytes:
    return pa.compress(ids.astype(np.int64).tobytes(), codec="zstd", asbytes=True)


def _expand(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, n * 8, codec="zstd", asbytes=True), np.int64)


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)], schema=fields)


def _dealt(key: np.ndarray, buckets: int) -> np.ndarray:
    return key % _MOD * _TIMES % _MOD % buckets


def _windows(texts: pa.Array, window: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window, its row) of all texts, in order; bits: how many leading bits of a hash count."""
    data, starts, ends, row = word_spans(texts)
    h, first = window_hashes(hash_spans(data, starts, ends), row, window)
    return (h if bits >= 64 else h >> np.uint64(64 - bits) << np.uint64(64 - bits)), row[first] if len(first) else first


def _notes(doc: np.ndarray, h: np.ndarray, ref: np.ndarray, buckets: int) -> Iterator[tuple]:
    """(bucket, n, documents, hashes, references) for each bucket of documents; hashes by their leading 48 bits."""
    to = _dealt(doc, buckets)
    order = np.lexsort((doc, to))
    to, doc, h, ref = to[order], doc[order], h[order], ref[order]
    first = np.flatnonzero(np.insert(to[1:] != to[:-1], 0, True))
    for a, b in zip(first.tolist(), np.append(first[1:], len(to)).tolist(), strict=True):
        leading = np.ascontiguousarray(h[a:b].view(np.uint8).reshape(-1, 8)[:, 2:])
        yield int(to[a]), b - a, _squeeze(doc[a:b]), leading.tobytes(), _squeeze(ref[a:b])


def _repeats(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
    """h is sorted. (index of each member of a group that shares a hash, its document, the group's smallest, notes: documents, hashes, references).

    Notes go to all members but the smallest, and to the smallest as the one that serves.
    """
    same = h[1:] == h[:-1]
    member = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))
    hm, dm = h[member], doc[member]
    if not len(member):
        return member, dm, dm, (dm, hm, dm)
    first = np.flatnonzero(np.insert(hm[1:] != hm[:-1], 0, True))
    smallest = np.minimum.reduceat(dm, first)
    least = np.repeat(smallest, np.diff(np.append(first, len(hm))))
    hit, serves = dm > least, np.maximum.reduceat(dm, first) > smallest
    notes = tuple(np.concatenate(x) for x in ((dm[hit], smallest[serves]), (hm[hit], hm[first][serves]), (least[hit], smallest[serves])))
    return member, dm, least, notes


def _index_blocks(window: int, buckets: int, bits: int):
    fields = _NOTE_FIELDS.append(pa.field("head", pa.binary()))
    step = -(-(1 << 64) // buckets)

    def flush(hashes: list, docs: list) -> Iterator[pa.RecordBatch]:
        h, doc = np.concatenate(hashes), np.concatenate(docs)
        hashes.clear(), docs.clear()
        order = np.argsort(h)
        h, doc = h[order], doc[order]
        del order
        member, dm, least, notes = _repeats(h, doc)
        if len(notes[0]):
            yield _batch([(*x, None) for x in _notes(*notes, buckets)], fields)
        keep = np.ones(len(h), bool)
        keep[member[dm > least]] = False
        kept = np.flatnonzero(keep)
        again = (h[kept][1:] == h[kept][:-1]) & (doc[kept][1:] == doc[kept][:-1])  # repeats within a document
        kept = kept[np.insert(~again, 0, True)] if len(kept) else kept
        h, doc = h[kept], doc[kept]
        edges = np.searchsorted(h, np.array([min(k * step, (1 << 64) - 1) for k in range(1, buckets)], np.uint64)).tolist()
        rows = []
        for k, (a, b) in enumerate(pairwise([0, *edges, len(h)])):
            if a < b:
                ids, rank = np.unique(doc[a:b], return_inverse=True)
                gaps = np.diff(h[a:b], prepend=h[a])
                w, v = _width(gaps), _width(rank)
                head = np.array([w, v, len(ids), h[a]], np.uint64).tobytes()
                rows.append((k, b - a, _squeeze(ids), _pack(gaps, w), _pack(rank, v), head))
        yield _batch(rows, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, docs, held = [], [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b in pieces(batch.column(1)):
                h, row = _windows(batch.column(1).slice(a, b - a), window, bits)
                hashes.append(h)
                docs.append(ids[a + row])
                held += len(h)
                if held >= RUN:
                    yield from flush(hashes, docs)
                    held = 0
        if held:
            yield from flush(hashes, docs)

    return run


def _lookup(buckets: int):
    """The index blocks of a bucket, or of some buckets, to notes; notes that are there already go through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            index = pc.is_valid(batch.column(5))
            known = batch.filter(pc.invert(index))
            if len(known):
                yield pa.RecordBatch.from_arrays(known.columns[:5], schema=_NOTE_FIELDS)
            for bucket, n, ids, gaps, rank, head in zip(*(c.to_pylist() for c in batch.filter(index).columns), strict=True):
                w, v, k, start = (int(x) for x in np.frombuffer(head, np.uint64))
                h = np.cumsum(_unpack(gaps, n, w)) + np.uint64(start)
                held.setdefault(bucket, []).append((h, _expand(ids, k)[_unpack(rank, n, v).astype(np.int64)]))
        while held:
            parts = held.popitem()[1]
            h, doc = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
            del parts
            order = np.argsort(h)
            notes = _repeats(h[order], doc[order])[3]
            if len(notes[0]):
                yield _batch(list(_notes(*notes, buckets)), _NOTE_FIELDS)

    return run


def _gathered(buckets: int):
    """Texts to compressed parcels of each bucket of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held)
            to = _dealt(rows.column(0).to_numpy(), buckets)
            order = np.argsort(to, kind="stable")
            cut = np.flatnonzero(np.insert(np.diff(to[order]) != 0, 0, True))
            out = []
            for a, b in pairwise([*cut.tolist(), len(order)]):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, _TEXT_FIELDS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(rows.take(order[a:b]))
                out.append((int(to[order[a]]), sink.getvalue().to_pybytes()))
            held.clear()
            return _batch(out, pa.schema([("bucket", pa.int32()), ("parcel", pa.binary())]))

        for batch in batches:
            columns = [batch.column(0), batch.column(1), batch.column(2).cast(pa.large_string())]
            held.append(pa.RecordBatch.from_arrays(columns, schema=_TEXT_FIELDS))
            size += batch.nbytes
            if size >= GATHER:
                yield flush()
                size = 0
        if sum(map(len, held)):
            yield flush()

    return run


def _factors(begin: np.ndarray, ref: np.ndarray, window: int) -> list[dict]:
    """Factors (start, n, ref) from the windows that have a reference: each runs on while the next window has the same one."""
    if not len(begin):
        return []
    new = np.flatnonzero(np.insert((np.diff(begin) != 1) | (ref[1:] != ref[:-1]), 0, True))
    n = begin[np.append(new[1:], len(begin)) - 1] + window - begin[new]
    return [{"start": s, "n": k, "ref": r} for s, k, r in zip(begin[new].tolist(), n.tolist(), ref[new].tolist(), strict=True)]


def _parse(window: int, bits: int):
    """Rows (parcel, n, docs, hashes, refs), notes first and then parcels of the texts they are for, to rows, claims and blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, doc, h, refs = [], np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        number, claimed = TaskContext.get().partitionId() << 33, set()
        for batch in batches:
            is_text = pc.is_valid(batch.column(0))
            for n, docs, hashes, ref in zip(*(c.to_pylist() for c in batch.filter(pc.invert(is_text)).columns[1:]), strict=True):
                held.append((_expand(docs, n), np.frombuffer(hashes, np.uint8).reshape(-1, 6), _expand(ref, n)))
            parcels = batch.filter(is_text).column(0)
            if held and len(parcels):
                doc = np.concatenate([x[0] for x in held])
                wide = np.zeros((len(doc), 8), np.uint8)
                np.concatenate([x[1] for x in held], out=wide[:, 2:])
                refs, h = np.concatenate([x[2] for x in held]), wide.reshape(-1).view(np.uint64)
                held = []
                order = np.lexsort((refs, h, doc))
                doc, h, refs = doc[order], h[order], refs[order]
            for parcel in parcels:
                for part in pa.ipc.open_stream(parcel.as_buffer()):
                    for a, b in pieces(part.column(2)):
                        piece = part.slice(a, b - a)
                        yield from parsed(piece, number, claimed, doc, h, refs)
                        number += len(piece)

    def parsed(part: pa.RecordBatch, number: int, claimed: set, doc: np.ndarray, h: np.ndarray, refs: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, texts = part.column(0).to_numpy(), part.column(2)
        found, row = _windows(texts, window, bits)
        found = found >> np.uint64(16) << np.uint64(16)
        at = np.searchsorted(row, np.arange(len(keys) + 1)).tolist()
        lo, hi = np.searchsorted(doc, keys).tolist(), np.searchsorted(doc, keys, "right").tolist()
        factors: list[list] = [[]] * len(keys)
        claims, blocks = [], []
        for i, key in enumerate(keys.tolist()):
            if lo[i] == hi[i] or at[i] == at[i + 1]:
                continue
            hs, rs, mine = h[lo[i] : hi[i]], refs[lo[i] : hi[i]], found[at[i] : at[i + 1]]
            words = texts[i].as_py().encode().split()
            serve = rs == key
            for known, of in ((hs[~serve], rs[~serve]), (hs[serve], rs[serve])):
                if not len(known):
                    continue
                place = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                begin = np.flatnonzero(known[place] == mine)
                out = _factors(begin, of[place[begin]], window)
                for f in out:
                    run_ = b" ".join(words[f["start"] : f["start"] + f["n"]])
                    if f["ref"] == key:
                        blocks.append((key, run_))
                    elif (claim := (f["ref"], run_)) not in claimed:  # no more than the partition's texts
                        claimed.add(claim)
                        claims.append(claim)
                if of[0] != key:
                    factors[i] = out
        n = len(keys)
        none = lambda t: pa.nulls(n, t)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, _ROW, np.int32)), pa.array(np.arange(number, number + n)), part.column(0), part.column(1), texts.cast(pa.string()), pa.array(factors, pa.list_(_FACTOR)), none(pa.int64()), none(pa.binary())], schema=_PARSED_FIELDS)
        for kind, some in ((_CLAIM, claims), (_BLOCK, blocks)):
            if some:
                yield _batch([(kind, None, None, None, None, None, r, w) for r, w in some], _PARSED_FIELDS)

    return run


class _Blocks:
    """The words of a reference's blocks, and where each window stands in them."""

    def __init__(self, blocks: list[bytes], window: int):
        self.words = [w for b in blocks for w in b.split()]
        ends = np.cumsum([b.count(b" ") + 1 for b in blocks])
        h, row = _windows(pa.array(blocks, pa.binary()).cast(pa.large_binary()).view(pa.large_string()), window, 64)
        size = np.diff(ends, prepend=0) - window + 1
        first = np.repeat(ends - np.diff(ends, prepend=0) - np.append(0, np.cumsum(size)[:-1]), size)
        place = first + np.arange(len(h))
        order = np.argsort(h, kind="stable")
        self.hashes, self.places, self.ends, self.window = h[order], place[order].tolist(), ends[row[order]].tolist(), window

    def missing(self, claim: bytes) -> list[int]:
        """The claim parsed greedily: the longest factor at its start, then at the first window that crosses its end, and so on. Starts of windows that no block holds."""
        words, out, i = claim.split(), [], 0
        h = _windows(pa.array([claim], pa.binary()).cast(pa.large_binary()).view(pa.large_string()), self.window, 64)[0]
        lo, hi = np.searchsorted(self.hashes, h).tolist(), np.searchsorted(self.hashes, h, "right").tolist()
        while i < len(h):
            best = 0
            for k in range(lo[i], hi[i]):
                best = max(best, self._length(words, i, self.places[k], min(self.ends[k] - self.places[k], len(words) - i)))
                if best == len(words) - i:
                    break
            if best < self.window:
                out.append(i)
            i += max(1, best - self.window + 1)
        return out

    def _length(self, words: list[bytes], i: int, p: int, most: int) -> int:
        """How many words from i on are those from p on."""
        done, step = 0, self.window
        while step and done < most:
            step = min(step, most - done)
            if words[i + done : i + done + step] == self.words[p + done : p + done + step]:
                done, step = done + step, 2 * step
            else:
                step //= 2
        return done


def _compared(window: int, bits: int):
    """Rows (ref, part, kind, words), the blocks of a part before its claims, to hashes of windows that claims hold and blocks don't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, blocks, text, index = None, [], None, None
        for batch in batches:
            bad: set[int] = set()
            for ref, part, kind, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (ref, part) != at:
                    at, blocks, text, index = (ref, part), [], None, None
                if kind == _BLOCK:
                    blocks.append(words)
                    continue
                text = b"\n".join(b" " + b + b" " for b in blocks) if text is None else text
                if b" " + words + b" " in text:  # one factor
                    continue
                index = index or _Blocks(blocks, window)
                if lost := index.missing(words):
                    h = _windows(pa.array([words], pa.binary()).cast(pa.large_binary()).view(pa.large_string()), window, bits)[0]
                    bad.update(h[lost].view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(list(bad), pa.int64())], names=["h"])

    return run


def _mismatched(parsed: DataFrame, window: int, bits: int, claims_bytes: int) -> DataFrame:
    """h: hashes of windows that were claimed and that the reference does not hold."""
    claims, blocks = (parsed.where(F.col("kind") == k).select("ref", "kind", "words") for k in (_CLAIM, _BLOCK))
    large = materialize(claims.groupBy("ref").agg(F.sum(F.length("words")).alias("bytes")).where(F.col("bytes") > claims_bytes).select("ref", F.ceil(F.col("bytes") / claims_bytes).cast("int").alias("parts")))
    if large.isEmpty():
        both = claims.unionByName(blocks).withColumn("part", F.lit(0))
    else:
        parts = F.coalesce("parts", F.lit(1))
        claims = claims.join(large, "ref", "left").withColumn("part", F.pmod(F.xxhash64("words"), parts).cast("int"))
        blocks = blocks.join(large, "ref", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        both = claims.unionByName(blocks).drop("parts")
    n = partitions_for(parsed)
    dealt = both.repartition(n, "ref", "part").sortWithinPartitions("ref", "part", F.col("kind").desc())
    return materialize(dealt.select("ref", "part", "kind", "words").mapInArrow(_compared(window, bits), "h long").distinct())


def _suspects(known: np.ndarray, window: int, bits: int):
    """Rows (row, key, text) to windows whose hash is among known: row, key, start, words."""
    fields = pa.schema([("row", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(2)):
                part = batch.slice(a, b - a)
                h, row = _windows(part.column(2), window, bits)
                begin = np.searchsorted(row, np.arange(len(part)))
                found = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
                out, words, at = [], [], -1
                for k, r in zip(found.tolist(), row[found].tolist(), strict=True):
                    if r != at:
                        at, words = r, part.column(2)[r].as_py().encode().split()
                    i = k - int(begin[r])
                    out.append((part.column(0)[r].as_py(), part.column(1)[r].as_py(), i, b" ".join(words[i : i + window])))
                yield _batch(out, fields)

    return run


def _mended(rows: DataFrame, bad: DataFrame, window: int, bits: int) -> DataFrame:
    """row, windows (start, ref or null): of the windows of bad hashes, the smallest document below the row's that holds the same words."""
    n, found = -(-bad.count() // APART), None
    for k in range(n):
        known = np.sort(np.array([r.h for r in bad.where(F.pmod(F.xxhash64("h"), F.lit(n)) == k).toLocalIterator()], np.int64).view(np.uint64))  # about APART numbers
        if len(known):
            some = rows.select("row", "key", "text").mapInArrow(_suspects(known, window, bits), "row long, key long, start int, words binary")
            found = some if found is None else found.unionByName(some)
    found = materialize(found)
    least = found.groupBy("words").agg(F.min("key").alias("least"))
    ref = F.when(F.col("least") < F.col("key"), F.col("least"))
    return found.join(least, "words").groupBy("row").agg(F.collect_list(F.struct("start", ref.alias("ref"))).alias("windows"))


def _kept(window: int):
    """Rows (doc_id, text, factors, windows) to what is left of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces(batch.column(1)):
                part = batch.slice(a, b - a)
                kept, n_words, n_removed, all_factors = [], [], [], []
                for text, factors, windows in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    words = (text or "").encode().split()
                    if windows:
                        refs = {s: f["ref"] for f in factors for s in range(f["start"], f["start"] + f["n"] - window + 1)}
                        refs |= {w["start"]: w["ref"] for w in windows}
                        some = sorted((s, r) for s, r in refs.items() if r is not None)
                        factors = _factors(np.array([s for s, _ in some], np.int64), np.array([r for _, r in some], np.int64), window)
                    if factors:
                        cover = np.ones(len(words), bool)
                        for f in factors:
                            cover[f["start"] : f["start"] + f["n"]] = False
                        left = list(compress(words, cover.tolist()))
                    else:
                        left = words
                    kept.append(b" ".join(left)), n_words.append(len(words)), n_removed.append(len(words) - len(left)), all_factors.append(factors)
                columns = [part.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(all_factors, pa.list_(_FACTOR))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "kept_text", "n_words", "n_removed", "factors"])

    return run


def relative_parse(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", bits: int = 64, claims_bytes: int = CLAIMS) -> DataFrame:
    """One row per row of docs: doc_id, kept_text (words joined by a space), n_words, n_removed and the factors (start, n, ref) in words.

    Factors may share up to window - 1 words with the next one. bits: leading bits of window hashes that count, fewer than 64 in tests only.
    """
    n = partitions_for(docs)
    doc_id = F.col(id_col).cast("long")
    rows = docs.select(F.coalesce(doc_id, F.lit(_LAST)).alias("key"), doc_id.alias("doc_id"), F.col(text_col).alias("text"))
    blocks = rows.select("key", "text").mapInArrow(_index_blocks(window, n, bits), _BLOCKS).repartitionById(n, F.col("bucket"))
    notes = blocks.mapInArrow(_lookup(n), _NOTES)
    both = rows.mapInArrow(_gathered(n), "bucket int, parcel binary").unionByName(notes, allowMissingColumns=True)
    both = both.repartitionById(n, F.col("bucket")).sortWithinPartitions(F.col("parcel").isNotNull())
    parsed = materialize(both.select("parcel", "n", "docs", "hashes", "refs").mapInArrow(_parse(window, bits), _PARSED), "zstd")
    out = parsed.where(F.col("kind") == _ROW).select("row", "key", "doc_id", "text", "factors")
    bad = _mismatched(parsed, window, bits, claims_bytes)
    if bad.isEmpty():
        out = out.withColumn("windows", F.lit(None).cast("array<struct<start:int,ref:long>>"))
    else:
        out = out.join(_mended(out, bad, window, bits), "row", "left")
    schema = "doc_id long, kept_text string, n_words long, n_removed long, factors array<struct<start:int,n:int,ref:long>>"
    return out.select("doc_id", "text", "factors", "windows").mapInArrow(_kept(window), schema)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relative_parse(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), f AS (
  SELECT s, min(doc_id) AS least FROM p GROUP BY s HAVING min(doc_id) < max(doc_id)
), c AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM p JOIN f USING (s) WHERE doc_id > least
), r AS (
  SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id
), k AS (
  SELECT d.doc_id, d.w, coalesce(r.gone, []::BIGINT[]) AS gone FROM d LEFT JOIN r USING (doc_id)
), x AS (
  SELECT k.doc_id, u.word, u.i FROM k, LATERAL (SELECT unnest(k.w) AS word, unnest(range(1, len(k.w) + 1)) AS i) u
), y AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS s FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.i = c.i GROUP BY x.doc_id
)
SELECT k.doc_id, CAST(len(k.w) AS BIGINT) AS n_words, CAST(len(k.gone) AS BIGINT) AS n_removed, sha256(coalesce(y.s, '')) AS kept_sha256
FROM k LEFT JOIN y USING (doc_id)
"""
