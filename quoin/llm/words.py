"""Vectorised word and word-window hashes over Arrow string columns, for the operators written in numpy.

Words are runs of bytes other than space and U+0009 to U+000D. A word's hash is a polynomial in its bytes modulo 2**64 from
running sums, then mixed; a window's hash is a polynomial in its words' hashes. Equal words always have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text that are hashed at a time; a longer text is hashed alone.
PIECE = 1 << 21

_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16, len(_powers[0]) * 5 // 4 if _powers else 0)
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = []
        for base in (_BASE, inverse):
            steps = np.full(size, np.uint64(base % (1 << 64)))
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pieces(column: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together hold about so many bytes."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, len(column))
        first = min(last, len(column))


def word_spans(column: pa.Array, breaks: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts (null: none), each word's start and end in them, and each word's row; breaks: which bytes end words."""
    column = column.cast(pa.large_string()).fill_null("")
    column = pa.concat_arrays([column]) if column.offset else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    if hi == lo:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint8), none, none, none
    data = np.frombuffer(column.buffers()[2], np.uint8, hi - lo, lo)
    offsets = offsets - lo
    space = breaks[data]
    before = np.ones(len(data) + 1, bool)
    before[1:] = space
    before[offsets] = True
    starts = np.flatnonzero(~space & before[:-1])
    after = np.ones(len(data) + 1, bool)
    after[:-1] = space
    after[offsets] = True
    ends = np.flatnonzero(~space & after[1:]) + 1
    return data, starts, ends, np.searchsorted(offsets, starts, "right") - 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts])


def window_hashes(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window of n consecutive words of one row, index of its first word)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words[:m].copy()
    for k in range(1, n):
        h *= _STEP
        h += words[k : k + m]
    first = np.flatnonzero(row[:m] == row[n - 1 :])
    return mix64(h[first]), first
