"""Substring deduplication by compaction of a de Bruijn graph of token k-mers.

Every window of ``k`` words is an edge from its first k - 1 words to its last. A word goes where it lies in a window
whose words also start anywhere else. Edges are not handled one by one:

* Compaction in a block: of the ``ANCHOR``-word sequences of a window the one of smallest hash (the first, if several)
  is its anchor. Equal windows have equal anchors. Consecutive edges with one anchor are a path, with one
  128-bit digest over all its words.
* Paths are counted by digest. A path that occurs twice is repeated as a whole, and all its edges with it. An anchor
  with two different paths is a branching place: sources part there, and part of a path may still be repeated. All other
  paths hold nothing that is repeated.
* A second scan gives the source coordinates (document, first word, edges) of repeated paths and of paths at branching places, found
  with bitmaps of at most 8 MB, which lose none. A join with the repeated paths decides on whole paths.
* At branching places paths that occur once, and one occurrence of each repeated path, come with the digests of their edges.
  These are counted, and the repeated ones joined back to the coordinates of the opened paths.
* Neighbouring and overlapping spans of a document become one cover, which is joined to its text.

Digests are 128 bits over 64-bit hashes of words (as written, without lower-casing). A row is known by 128 bits of its
id and text, so repeated and null ids are told apart by their texts.

Nulls: a null text has no words; a null id is an id like others. Identical rows repeat each other. A text of fewer than ``k``
words has no window and keeps all. A repetition within a text counts, overlapping itself too. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netpulse.llm.common import id_text, materialize, written
from netpulse.llm.textops import U64, Hasher, buffers, mix
from netpulse.llm.textruns import WORD_END, coded, gathered, hash_filter, passes, runs

WINDOW, ANCHOR = 35, 8  # words
BLOCK = 6 << 20  # bytes of text worked on at once
RANGE = 1 << 20  # edges worked on at once
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)  # odd
_PLACE = (1 << 24) - 1


class Sequences:
    """Digests of any run of words in a list, from prefix sums modulo 2**64 under two bases."""

    def __init__(self) -> None:
        self.powers: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, U64), np.ones(1, U64))] * 2

    def over(self, h: np.ndarray) -> None:
        n = len(h)
        if len(self.powers[0][0]) <= n:
            self.powers = []
            for base in _BASES:
                step, back = np.full(n + n // 8 + 1, base, U64), np.full(n + n // 8 + 1, pow(base, -1, 1 << 64), U64)
                step[0] = back[0] = 1
                self.powers.append((np.multiply.accumulate(step), np.multiply.accumulate(back)))
        self.total = []
        for up, _ in self.powers:
            t = np.zeros(n + 1, U64)
            np.cumsum(h * up[:n], out=t[1:])
            self.total.append(t)

    def digest(self, which: int, start, end) -> np.ndarray:
        """Of the words from ``start`` to before ``end`` (slices or arrays of places)."""
        t, (_, back) = self.total[which], self.powers[which]
        size = np.asarray(end - start).astype(U64)
        return mix((t[end] - t[start]) * back[start] + size * U64(0xD6E8FEB86659FD93), 90 + which)


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


class Paths:
    """Paths of a range of the words ``h`` (rows ``row``): ``anchor``, two digests, ``row``, place of the ``first`` word in the
    range, number of ``edges``."""

    def __init__(self, sequences: Sequences, h: np.ndarray, row: np.ndarray, k: int) -> None:
        sequences.over(h)
        self.sequences, self.k = sequences, k
        size = min(ANCHOR, k)
        n = len(h) - k + 1  # windows
        at = np.arange(len(h) - size + 1)
        value = sequences.digest(0, at, at + size)
        # hash and place in one value: of equal hashes the first is taken
        place = (smallest((value & ~U64(_PLACE)) | at.astype(U64), k - size + 1) & U64(_PLACE)).astype(np.int64)
        edge = np.flatnonzero(row[:n] == row[k - 1 :])  # windows within one text
        new = np.append(True, (place[edge[1:]] != place[edge[:-1]]) | (edge[1:] != edge[:-1] + 1))[: len(edge)]
        self.first = edge[new]
        self.edges = np.diff(np.append(np.flatnonzero(new), len(edge)))
        self.row = row[self.first]
        self.anchor = value[place[self.first]]
        self.low, self.high = (sequences.digest(w, self.first, self.first + self.edges + k - 1) for w in (0, 1))

    def edge_digests(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all edges of the chosen paths, path after path (before another range is worked on)."""
        n = self.edges[chosen]
        at = np.repeat(self.first[chosen] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return tuple(self.sequences.digest(w, at, at + self.k) for w in (0, 1))


def case_sensitive() -> Hasher:
    hasher = Hasher()
    hasher.code = mix(np.arange(256, dtype=U64), 7)
    return hasher


def block_paths(batches, k: int):
    """(table of rows, paths, first word of each path in its text) of every range of a block's words."""
    hasher, sequences = case_sensitive(), Sequences()
    for table in gathered(batches, BLOCK):
        buf, off = buffers(table.column("text"))
        solid = ~WORD_END[buf]
        start, end, row = runs(solid, off)
        if len(row) < k:
            continue
        codes, words = coded(buf, solid, start, end)
        wbuf, woff = buffers(words)
        h = hasher._hash(wbuf, woff[:-1], woff[1:])[codes]
        begin = np.searchsorted(row, np.arange(len(off)))
        for a in range(0, len(h) - k + 1, RANGE):
            b = min(len(h), a + RANGE + k - 1)
            p = Paths(sequences, h[a:b], row[a:b], k)
            yield table, p, p.first + a - begin[p.row]


def _paths(k: int):
    """(anchor, low, high, n, k1): a range's distinct paths, how often it has them, and the row of one of them."""

    def run(batches):
        for table, p, _ in block_paths(batches, k):
            order = np.lexsort((p.high, p.low))
            low, high = p.low[order], p.high[order]
            first = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))[: len(low)])
            of = order[first]
            out = [p.anchor[of].view(np.int64), low[first].view(np.int64), high[first].view(np.int64), np.diff(np.append(first, len(low))),
                   table.column("k1").to_numpy()[p.row[of]]]
            for a in range(0, len(first), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000]) for c in out], ["anchor", "low", "high", "n", "k1"])

    return run


def _passing(bitmap: np.ndarray, column: str):
    """Rows whose ``column`` passes the bitmap."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(passes(bitmap, batch.column(column).to_numpy())))

    return run


PLACED = "low long, high long, k1 long, k2 long, first int, edges int, inner array<struct<low: long, high: long>>"


def _places(k: int, repeated: np.ndarray, open_paths: np.ndarray, samples: np.ndarray):
    """Coordinates of paths whose anchors pass ``repeated`` or which pass ``open_paths``; with the digests of their edges where they
    pass ``open_paths``, or their row and they pass ``samples``."""

    def run(batches):
        for table, p, first in block_paths(batches, k):
            keys = [table.column(c).to_numpy()[p.row] for c in ("k1", "k2")]
            opened = passes(open_paths, p.low)
            chosen = np.flatnonzero(opened | passes(repeated, p.anchor))
            opened |= passes(samples, p.low ^ keys[0].view(U64))
            for a in range(0, len(chosen), 20_000):
                some = chosen[a : a + 20_000]
                inner = p.edge_digests(some[opened[some]])
                at = np.append(0, np.cumsum(np.where(opened[some], p.edges[some], 0))).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(d.view(np.int64)) for d in inner], ["low", "high"])
                lists = pa.ListArray.from_arrays(pa.array(at), pairs, mask=pa.array(~opened[some]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(p.low[some].view(np.int64)), pa.array(p.high[some].view(np.int64)), *[pa.array(c[some]) for c in keys],
                     pa.array(first[some].astype(np.int32)), pa.array(p.edges[some].astype(np.int32)), lists],
                    ["low", "high", "k1", "k2", "first", "edges", "inner"])

    return run


def _flat(inner: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(the list of every item, items' fields) of lists without nulls."""
    items = inner.flatten()
    return np.repeat(np.arange(len(inner)), pc.list_value_length(inner).to_numpy()), [items.field(c).to_numpy() for c in ("low", "high")]


def _edges(batches):
    """(low, high, n) of the paths' edges: an edge of a repeated path counts twice."""
    for batch in batches:
        of, (low, high) = _flat(batch.column("inner"))
        n = np.where(batch.column("whole").to_numpy(zero_copy_only=False), 2, 1)[of]
        yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high), pa.array(n)], ["low", "high", "n"])


def _edge_places(again: np.ndarray):
    """(low, high, k1, k2, first) of the edges that pass ``again``."""

    def run(batches):
        for batch in batches:
            of, (low, high) = _flat(batch.column("inner"))
            at = np.searchsorted(of, np.arange(len(batch)))
            here = passes(again, low)
            first = batch.column("first").to_numpy()[of] + (np.arange(len(of)) - at[of])
            keys = [batch.column(c).to_numpy()[of[here]] for c in ("k1", "k2")]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (low[here], high[here], *keys, first[here].astype(np.int32))],
                                             ["low", "high", "k1", "k2", "first"])

    return run


def repeated_spans(rows: DataFrame, k: int = WINDOW) -> DataFrame:
    """(k1, k2, first, edges): runs of windows of a row that occur anywhere else too, by the row's key. ``rows``: k1, k2, text."""
    paths = rows.select("k1", "text").mapInArrow(_paths(k), "anchor long, low long, high long, n long, k1 long")
    paths = paths.groupBy("anchor", "low", "high").agg(F.sum("n").alias("n"), F.min("k1").alias("k1"))
    again = F.col("n") > 1
    paths = written(paths.select("anchor", "low", F.when(again, F.col("high")).alias("high"), F.when(again, F.col("k1")).alias("k1")), "substring-paths")
    whole = materialize(paths.where("high is not null"))
    branching = paths.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    branching = hash_filter(materialize(branching))
    # of the paths at branching places: those that occur once, and a place of each that is repeated
    at_branch = _passing(branching, "anchor")
    once = paths.where("high is null").select("anchor", "low").mapInArrow(at_branch, "anchor long, low long").select("low")
    samples = whole.mapInArrow(at_branch, whole.schema).select(F.col("low").bitwiseXOR(F.col("k1")).alias("low"))
    placed = rows.mapInArrow(_places(k, hash_filter(whole.select("anchor")), hash_filter(once), hash_filter(samples)), PLACED)
    whole = materialize(whole.select("low", "high", F.lit(True).alias("whole")))
    placed = placed.join(whole, ["low", "high"], "left").where("whole or inner is not null")
    placed = written(placed.select("k1", "k2", "first", "edges", F.coalesce("whole", F.lit(False)).alias("whole"), "inner"), "substring-places")

    opened = placed.where("inner is not null").select("inner", "whole").mapInArrow(_edges, "low long, high long, n long")
    again = materialize(opened.groupBy("low", "high").agg(F.sum("n").alias("n")).where("n > 1").select("low", "high"))
    single = placed.where("not whole").select("k1", "k2", "first", "inner")
    single = single.mapInArrow(_edge_places(hash_filter(again.select("low"))), "low long, high long, k1 long, k2 long, first int")
    single = single.join(again, ["low", "high"], "left_semi").select("k1", "k2", "first", F.lit(1).alias("edges"))
    return placed.where("whole").select("k1", "k2", "first", "edges").unionByName(single)


def _kept(k: int):
    """Words of each text that no span covers, joined by single spaces."""

    def run(batches):
        for table in gathered(batches, BLOCK):
            n_rows = table.num_rows
            buf, off = buffers(table.column("text"))
            # one byte after every text, so that each word is followed by one that can hold its space
            size = np.diff(off)
            full = np.full(len(buf) + n_rows, 32, np.uint8)
            full[np.arange(len(buf)) + np.repeat(np.arange(n_rows), size)] = buf
            off = off + np.arange(n_rows + 1)
            solid = ~WORD_END[full]
            start, end, row = runs(solid, off)
            begin = np.searchsorted(row, np.arange(n_rows + 1))
            spans = pa.concat_arrays(table.column("spans").chunks)
            of, flat = np.repeat(np.arange(n_rows), pc.fill_null(pc.list_value_length(spans), 0).to_numpy()), spans.flatten()
            first, edges = (flat.field(c).to_numpy().astype(np.int64) for c in ("first", "edges"))
            change = np.zeros(len(start) + 1, np.int64)
            np.add.at(change, begin[of] + first, 1)
            np.add.at(change, begin[of] + first + edges + k - 1, -1)
            keep = np.cumsum(change[:-1]) == 0
            letter = np.zeros(len(full), bool)
            letter[solid] = np.repeat(keep, end - start)
            letter[end[keep]] = True
            full[end[keep]] = 32
            at = np.concatenate([[0], np.cumsum(letter)])[off]
            text = full[letter]
            left = np.add.reduceat(np.append(keep, False), begin[:-1]) * (np.diff(begin) > 0) if n_rows else np.zeros(0, np.int64)
            out = [text[a : b - 1].tobytes() if b > a else b"" for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays(table.column("doc_id").chunks), pa.array(np.diff(begin)), pa.array(np.diff(begin) - left), pa.array(out, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every text without the words of windows that occur anywhere else too."""
    rows = id_text(docs, id_col, text_col).withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(1), "text", "doc_id")})
    spans = repeated_spans(rows.select("k1", "k2", "text"), k)
    # identical rows have the same spans
    covers = spans.distinct().groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "edges")).alias("spans"))
    covers = materialize(covers)
    return rows.join(covers, ["k1", "k2"], "left").select("doc_id", "text", "spans").mapInArrow(
        _kept(k), "doc_id long, n_words long, n_removed long, kept string")
