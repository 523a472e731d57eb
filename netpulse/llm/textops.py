"""Vectorized text work inside tasks: words, word hashes and shingles of an Arrow text column.

Words are maximal runs of bytes other than ``\\x20 \\x09-\\x0D`` after lower-casing A-Z. All
texts of a batch are hashed together: a polynomial over the bytes modulo 2**64 is summed once
along the batch, and a word's hash is the difference of two prefix sums times the inverse power
of its start, so no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C13  # odd, and 3 modulo 8: 1 - base has a single factor of two
_BASE_INV = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values (xor-shift and multiply steps), one for each salt."""
    x = x + U64((0x9E3779B97F4A7C15 * (2 * salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


class Hasher:
    """Tables for one task; powers grow to the longest batch seen."""

    def __init__(self) -> None:
        self.lower = _lower_table()
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.alnum = np.ones(256, bool)
        self.alnum[:128] = [chr(c).isalnum() for c in range(128)]
        self.code = mix(self.lower.astype(U64), 7)
        self.pow = self.inv = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self.pow) <= n:
            size = n + 1 + n // 8
            step = np.full(size, _BASE, U64)
            step[0] = 1
            self.pow = np.multiply.accumulate(step)
            step[1:] = U64(_BASE_INV)
            self.inv = np.multiply.accumulate(step)

    def words(self, buf: np.ndarray, off: np.ndarray):
        """(start, end) byte positions and the row of every word of the batch."""
        solid = ~self.space[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[off[:-1]] = True
        edge[len(buf)] = True
        first = solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last = solid
        last[:-1] &= ~solid[1:] | edge[1:-1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        row = np.searchsorted(off, start, side="right") - 1
        return start, end, row

    def word_hashes(self, buf: np.ndarray, off: np.ndarray):
        """(hash, row) of every word in order."""
        _, _, row, h = self.located_words(buf, off)
        return h, row

    def located_words(self, buf: np.ndarray, off: np.ndarray):
        """(start, end, row, hash) of every word in order."""
        start, end, row = self.words(buf, off)
        return start, end, row, self._hash(buf, start, end)

    def _hash(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._grow(len(buf))
        total = np.zeros(len(buf) + 1, U64)
        np.cumsum(self.code[buf] * self.pow[: len(buf)], out=total[1:])
        h = (total[end] - total[start]) * self.inv[start]
        return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def tokens(self, buf: np.ndarray, off: np.ndarray):
        """(start, end, row, hash) of every run of letters, digits and non-ASCII bytes."""
        solid = self.alnum[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[off[:-1]] = edge[len(buf)] = True
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last[:-1] &= ~solid[1:] | edge[1:-1]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return start, end, np.searchsorted(off, start, side="right") - 1, self._hash(buf, start, end)

    def shingles(self, buf: np.ndarray, off: np.ndarray, k: int):
        """(hash, row) of every window of k words; a text of 1 to k-1 words gives one over them all."""
        h, row = self.word_hashes(buf, off)
        n_rows = len(off) - 1
        count = np.bincount(row, minlength=n_rows)
        begin = np.concatenate([[0], np.cumsum(count)])
        out = [np.zeros(0, U64)]
        rows = [np.zeros(0, np.int64)]
        if len(h) >= k:
            acc = np.zeros(len(h) - k + 1, U64)
            for j in range(k):
                acc += mix(h[j : len(h) - k + 1 + j], j + 1)
            inside = row[: len(acc)] == row[k - 1 :]
            out.append(mix(acc[inside], 50))
            rows.append(row[: len(acc)][inside])
        for r in np.flatnonzero((count > 0) & (count < k)):
            part = h[begin[r] : begin[r + 1]]
            acc = np.zeros(1, U64)
            for j in range(len(part)):
                acc += mix(part[j : j + 1], j + 1)
            out.append(mix(acc, 60 + len(part)))
            rows.append(np.array([r]))
        hs, rs = np.concatenate(out), np.concatenate(rows)
        if len(out) > 2:
            order = np.argsort(rs, kind="stable")
            hs, rs = hs[order], rs[order]
        return hs, rs


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column (nulls as empty texts)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):  # no chunk at all
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def slices(col, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) in pieces of about ``limit`` bytes, whole texts each."""
    buf, off = buffers(col)
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b, buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def starts(row: np.ndarray, n_rows: int) -> np.ndarray:
    """Where each row's items begin, in an array sorted by row."""
    return np.searchsorted(row, np.arange(n_rows + 1))
