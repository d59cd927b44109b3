"""Words of whole Arrow text columns as numpy arrays.

A word is a run of bytes other than space and ``\\x09-\\x0D``. Everything here works on the UTF-8
buffer of a column in slices of bounded size, so that a task needs memory for a slice and not for
its partition, and no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 20
LONG_WORD = 1 << 12
SPACES = (32, 9, 10, 11, 12, 13)

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = [np.uint64(x | 1) for x in np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64).tolist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (finaliser of SplitMix64, public domain)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_FORWARD = _powers(_BASE, 2 * SLICE_BYTES)
_BACK = _powers(_INVERSE, 2 * SLICE_BYTES)


class Words(NamedTuple):
    """Of a slice of rows: each word's byte range, row and hash; ``first`` has a row's first word."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    data: np.ndarray


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the rows and the bytes of a string column; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets, data


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text; a longer text is a range of its own."""
    if not len(column):
        return
    offsets, _ = string_buffers(column)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield lo, hi
        lo = hi


def words(column: pa.Array, hashes: bool = True) -> Words:
    offsets, data = string_buffers(column)
    base = int(offsets[0]) if len(offsets) else 0
    offsets = offsets - base
    data = data[base : base + int(offsets[-1])]
    solid = ~_IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(column)), np.diff(first))
    return Words(start, end, row, first, hash_ranges(data, start, end) if hashes else None, data)


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ascending byte ranges that do not overlap, from prefix sums modulo 2^64."""
    out = np.empty(len(start), np.uint64)
    long = np.flatnonzero(end - start > LONG_WORD)
    lo, n = 0, len(start)
    stops = [*long.tolist(), n]
    for stop in stops:
        while lo < stop:
            hi = int(np.searchsorted(end[lo:stop], start[lo] + SLICE_BYTES, "right")) + lo
            hi = max(hi, lo + 1)
            base, top = start[lo], end[hi - 1]
            total = np.zeros(top - base + 1, np.uint64)
            np.cumsum(_BYTE[data[base:top]] * _FORWARD[: top - base], out=total[1:])
            at, to = start[lo:hi] - base, end[lo:hi] - base
            out[lo:hi] = (total[to] - total[at]) * _BACK[at]
            lo = hi
        if stop < n:
            out[stop] = xxhash.xxh64_intdigest(data[start[stop] : end[stop]].tobytes())
            lo = stop + 1
    return mix(out)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and word position of every run of ``k`` words of a text.

    A text of fewer words (but one at least) has one shingle, made of all of them.
    """
    n = len(w.hash)
    count = np.diff(w.first)
    m = max(n - k + 1, 0)
    value = np.zeros(m, np.uint64)
    for j in range(k):
        value += w.hash[j : j + m] * _STEP[j]
    whole = w.row[:m] == w.row[k - 1 : k - 1 + m] if m else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        extra = np.full(len(short), 0, np.uint64)
        for j in range(k - 1):
            here = count[short] > j
            extra[here] += w.hash[w.first[short[here]] + j] * _STEP[j]
        at = np.concatenate([at, w.first[short]])
        value = np.concatenate([value[whole], extra])
        order = np.argsort(at, kind="stable")
        at, value = at[order], value[order]
    else:
        value = value[whole]
    row = w.row[at]
    return mix(value), row, at - w.first[row]
