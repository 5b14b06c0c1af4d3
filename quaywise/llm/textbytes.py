"""Vectorised work on UTF-8 text columns: words, rolling hashes, runs of words.

A column of texts is taken as one byte array with offsets (its Arrow layout), in
chunks of a bounded number of bytes, so that no Python string is made per word.
A span's hash is the sum of one pseudo-random 64-bit number for each (place, byte), a
run's hash mixes those of its halves; neither is a polynomial, so no text is built that
collides by arithmetic alone. What a hash decides is compared on bytes or digests after.
Hashes are the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_ODD = U64(0x9E3779B97F4A7C15)
# The numbers of (place, byte) for the first places of a span, which nearly all words end in.
_NEAR = 64
_NUMBERS = mix64((np.arange(_NEAR * 256, dtype=U64) + U64(1)) * _ODD)


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``most`` bytes at most (one row at least)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], (offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes other than 0x20, 0x09-0x0D), and the first word of each text."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:n]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes give equal hashes wherever they stand."""
    out = np.empty(len(starts), dtype=U64)
    total = np.cumsum(ends - starts)
    lo = 0
    while lo < len(starts):
        # as many spans as hold about CHUNK_BYTES, one at least
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + CHUNK_BYTES, side="right")))
        out[lo:hi] = _hashed(data, starts[lo:hi], ends[lo:hi])
        lo = hi
    return out


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    group, place = ragged(size)
    code = place * 256 + data[starts[group] + place]
    if size.max(initial=0) <= _NEAR:
        numbers = _NUMBERS[code]
    else:
        numbers = mix64((code.astype(U64) + U64(1)) * _ODD)
    sums = np.zeros(len(numbers) + 1, dtype=U64)
    np.cumsum(numbers, out=sums[1:])
    edge = np.concatenate([[0], np.cumsum(size)])
    return mix64(sums[edge[1:]] - sums[edge[:-1]] + size.astype(U64) * U64(0xA24BAED4963EE407))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(mix64(a + _ODD) + b)


class Runs:
    """Hashes of runs of consecutive words: a run is put together from runs of 1, 2, 4, ... words."""

    def __init__(self, words: np.ndarray):
        self.levels = [words]

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(_pair(last[:-step], last[step:]) if len(last) > step else last[:0])
        return self.levels[k]

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        size = ends - starts
        h, at = size.astype(U64), starts.astype(np.int64)
        for k in range(int(size.max(initial=0)).bit_length() - 1, -1, -1):
            has = np.flatnonzero((size >> k) & 1)
            if len(has):
                h[has] = _pair(h[has], self._level(k)[at[has]])
                at[has] += 1 << k
        return mix64(h)


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each span of ``a`` has the bytes of its span of ``b`` (both of the given sizes)."""
    group, k = ragged(size)
    differs = a[a_starts[group] + k] != b[b_starts[group] + k]
    return np.bincount(group[differs], minlength=len(size)) == 0


def join_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of the words one space apart; the bytes end with a space."""
    size = ends - starts
    at = np.cumsum(size + 1) - (size + 1)
    out = np.full(int(size.sum()) + len(size), 32, dtype=np.uint8)
    group, k = ragged(size)
    out[at[group] + k] = data[starts[group] + k]
    return out, at, at + size


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of the given sizes: the group of each item and its place in the group."""
    counts = np.asarray(counts, dtype=np.int64)
    total = int(counts.sum())
    group = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return group, np.arange(total) - np.repeat(first, counts)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
