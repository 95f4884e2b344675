"""Vectorised byte and word work on Arrow string columns, used inside tasks.

A batch's texts are taken as one UTF-8 byte array with row offsets and are
handled in chunks of a few MB, so that memory doesn't follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Splitmix64 finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE_HASH = mix(np.arange(1, 257, dtype=U) * GOLD)
COEF = mix(np.arange(1001, 1033, dtype=U) * GOLD) | U(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d, o


def chunks(o: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``limit`` bytes, or of one row."""
    i, n = 0, len(o) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(o, o[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def powers(base: np.uint64, n: int) -> np.ndarray:
    p = np.full(max(n, 1), base, U)
    p[0] = 1
    return np.multiply.accumulate(p)


def word_spans(data: np.ndarray, o: np.ndarray, gaps: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the end) of the maximal runs
    of bytes other than ``gaps`` (\\x20 and \\x09-\\x0D); ``o`` starts at 0."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(o), np.int64)
    w = ~gaps[data]
    before = np.zeros(len(w) + 1, bool)
    before[1:] = w
    begins = o[:-1][o[:-1] < len(w)]
    prev = before[:-1]
    prev[begins] = False
    after = np.zeros(len(w), bool)
    after[:-1] = w[1:]
    stops = o[1:][o[1:] > 0] - 1
    after[stops] = False
    starts, ends = np.flatnonzero(w & ~prev), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, o)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, U)
    lens = ends - starts
    first = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=first[1:])
    at = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(first, lens)
    own = data[at + np.repeat(starts, lens)]
    h = np.add.reduceat(BYTE_HASH[own] * powers(COEF[0], int(lens.max()))[at], first)
    return mix(h + lens.astype(U) * GOLD)


def kgram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of the ``k`` bytes from each place, by doubling."""
    h, size = BYTE_HASH[data], 1
    out, used = None, 0
    base = COEF[1]
    while True:
        if k & size:
            if out is None:
                out, used = h, size
            else:  # the new, longer piece goes first
                n = len(data) - used - size + 1
                out = h[:max(n, 0)] * powers(base, used + 1)[used] + out[size:size + max(n, 0)]
                used += size
        if used == k:
            return mix(out)
        n = len(data) - 2 * size + 1
        if n <= 0:
            return np.zeros(0, U)
        h = h[:n] * powers(base, size + 1)[size] + h[size:size + n]
        size *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each ``w`` neighbours, by doubling."""
    if len(x) < w:
        return x[:0]
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = w - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x
