"""Byte-level text primitives: whole Arrow columns are cut into words and hashed without a Python loop over words."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes worked on at once; only a single longer document exceeds it.
SLICE_BYTES = 1 << 20


def _table(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Bytes of words ``[^\x20\x09-\x0D]+`` and of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
SPACED = ~_table((0x20, 0x20), (0x09, 0x0D))
ALNUM = ~_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and each row's bounds (rows + 1); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(bounds: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def spans(buf: np.ndarray, bounds: np.ndarray, member: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and each row's word bounds (rows + 1)."""
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(bounds), np.int64)
    word = member[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[bounds] = True
    start, stop = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | cut[1:-1]
    stop[:-1] &= ~word[1:] | cut[1:-1]
    s = np.flatnonzero(start)
    return s, np.flatnonzero(stop) + 1, np.searchsorted(s, bounds)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_BASE = 0x9E6C63D0876A9A35
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers = {_BASE: np.ones(1, U64), _UNBASE: np.ones(1, U64)}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers[base]
    while len(have) < n:
        have = np.concatenate([have, have * U64(pow(base, len(have), 1 << 64))])
    _powers[base] = have
    return have[:n]


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span: differences of one running polynomial over the buffer, moved to exponent zero."""
    if not len(start):
        return np.empty(0, U64)
    run = np.empty(len(buf) + 1, U64)
    run[0] = 0
    np.cumsum(_BYTE[buf] * _power(_BASE, len(buf)), out=run[1:])
    h = (run[end] - run[start]) * _power(_UNBASE, len(buf) + 1)[start]
    return mix(h + (end - start).astype(U64))


def rolling(hashes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive entries (rows ignored)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.zeros(n, U64)
    base = int(mix(np.array([seed], U64))[0]) | 1
    for t in range(k):
        out += hashes[t : t + n] * U64(pow(base, t, 1 << 64))
    return mix(out)


def hashed_words(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every whitespace-delimited word of many rows, and each row's word bounds; works slice by slice."""
    parts, counts = [], [np.zeros(1, np.int64)]
    for i, j in slices(bounds):
        part, own = buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        s, e, rows = spans(part, own)
        parts.append(word_hashes(part, s, e))
        counts.append(np.diff(rows))
    return np.concatenate([np.empty(0, U64), *parts]), np.cumsum(np.concatenate(counts))


def tidy() -> None:
    """Hand freed memory back: a worker that Spark keeps for later stages shouldn't hold the last one's buffers."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidied(run: Callable) -> Callable:
    """A function over batches that hands memory back every few batches and at its end."""

    @wraps(run)
    def clean(batches):
        try:
            for n, out in enumerate(run(batches)):
                yield out
                if n % 8 == 7:
                    tidy()
        finally:
            tidy()

    return clean


def split_rows(bounds: np.ndarray, n: int) -> np.ndarray:
    """The row of each of ``n`` items."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
