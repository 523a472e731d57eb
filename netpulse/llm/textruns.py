"""Runs of bytes of an Arrow text column: exact codes of words or terms, without a Python loop over them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netpulse.llm.textops import _lower_table, buffers


def byte_class(members: bytes) -> np.ndarray:
    """256 flags: which bytes belong to the class."""
    flags = np.zeros(256, bool)
    flags[list(members)] = True
    return flags


BLANK = byte_class(b" \t")
PIECE_END = byte_class(b".,;:!?\n\x0b\x0c\r")
WORD_END = byte_class(b" \t\n\x0b\x0c\r")
LETTER = byte_class(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))  # and all bytes of non-ASCII characters
LOWER = _lower_table()


ROW_BYTES = 16  # that a row counts for besides its text, so that empty texts do not gather without end


def gathered(batches: Iterator[pa.RecordBatch], limit: int, text: str = "text") -> Iterator[pa.Table]:
    """Tables of whole rows with about ``limit`` bytes of text each (a longer text has its own)."""
    held, size = [], 0
    for batch in batches:
        _, off = buffers(batch.column(text))
        off = off + ROW_BYTES * np.arange(len(off))
        a = 0
        while a < len(off) - 1:
            b = max(a + 1, int(np.searchsorted(off, off[a] + limit - size, side="right")) - 1)
            b = min(b, len(off) - 1)
            if held and size + off[b] - off[a] > limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                continue
            held.append(batch.slice(a, b - a))
            size += int(off[b] - off[a])
            a = b
    if held:
        yield pa.Table.from_batches(held)


def runs(solid: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of ``solid`` bytes within a row."""
    n = len(solid)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def coded(buf: np.ndarray, solid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A code for every run, and the distinct runs that the codes stand for (exact: bytes are compared)."""
    at = np.concatenate([[0], np.cumsum(end - start)])
    if at[-1] >= 1 << 31:
        raise ValueError("one piece of text is longer than 2 GB")
    if not len(start):
        return np.zeros(0, np.int32), pa.array([], pa.binary())
    found = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(buf[solid])]).dictionary_encode()
    return found.indices.to_numpy(), found.dictionary


def lines(text: np.ndarray) -> pa.Array:
    """The lines of UTF-8 bytes, none of which is empty, as an Arrow array."""
    inside = text != 10
    cut = np.flatnonzero(~inside)
    at = np.concatenate([[0], cut - np.arange(len(cut)), [inside.sum()]]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(text[inside])])


def text_codes(column) -> tuple[np.ndarray, list]:
    """A code for every value of a string column without nulls, and the distinct values."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    found = column.dictionary_encode()
    return found.indices.to_numpy(), found.dictionary.to_pylist()


def sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the exact sum of each one's weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[first], np.add.reduceat(weights, first)


def packed(arrays: list[np.ndarray]) -> tuple[bytes, int]:
    """Arrays one after another, each with its type and length before it, compressed; and the size before."""
    out = [len(arrays).to_bytes(4, "little")]
    for a in arrays:
        out += [a.dtype.str.encode().ljust(4), len(a).to_bytes(8, "little"), a.tobytes()]
    raw = b"".join(out)
    return pa.compress(raw, codec="zstd", asbytes=True), len(raw)


def unpacked(raw: bytes, size: int) -> list[np.ndarray]:
    raw = pa.decompress(raw, decompressed_size=size, codec="zstd", asbytes=True)
    out, at = [], 4
    for _ in range(int.from_bytes(raw[:4], "little")):
        kind, n = np.dtype(raw[at : at + 4].decode().strip()), int.from_bytes(raw[at + 4 : at + 12], "little")
        out.append(np.frombuffer(raw, kind, n, at + 12))
        at += 12 + n * kind.itemsize
    return out


def hash_filter(hashes: DataFrame, least_bits: int = 20, most_bits: int = 26) -> np.ndarray:
    """A bitmap in which the low bits of every value of ``hashes`` (one long column) are set: 32 bits a value, but never
    more than 2**most_bits (8 MB), whatever there is. It is a filter without losses: values that are not there may pass.
    Only its words that are not zero come to the driver."""
    (name,) = hashes.columns
    bits = min(most_bits, max(least_bits, (32 * hashes.count()).bit_length()))
    words_of = F.expr(f"cast(shiftright(`{name}` & {(1 << bits) - 1}L, 6) as int)")
    found = hashes.groupBy(words_of.alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(`{name}` & 63L as int)))").alias("bits")).toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return words.view(np.uint64)


def passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes pass the bitmap."""
    bit = hashes.view(np.uint64) & np.uint64(64 * len(bitmap) - 1)
    return ((bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
