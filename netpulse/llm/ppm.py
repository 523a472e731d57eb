"""Language-model scores by prediction by partial matching (PPM) over bytes.

Texts are lower-cased (A-Z) words joined by single spaces, closed by an end symbol; the bytes before
a text count as end symbols. The trie of contexts of up to ``ORDER`` bytes is kept as one table:
the training counts of all strings of ``ORDER + 1`` bytes, from which those of shorter contexts are
sums. A symbol's probability comes from the longest context that has it; on the way down every
context is left by an escape (method D: with n counts of d distinct symbols, d / 2n, and half a count
off each symbol) and its symbols are excluded from the shorter contexts. Below order 0 all symbols not seen are equal.

All training texts count, and the table is never broadcast: it grows with the corpus.
* Texts are shuffled into blocks; a block sends its distinct strings with their training counts.
* Strings are partitioned by their last two context bytes, so that all contexts of two bytes and
  more of a string are with it; orders 1 and 0 come from a 256 x 256 table (a fixed bound). There each
  distinct string's log probability is computed once, and joined back to the blocks that hold it.
* A block, its strings' probabilities and its texts meet again, and every whole text is summed.
The add-one unigram score of words is made the same way, from 64-bit word hashes; only words that
more than one block holds need an answer.

Nulls: a null text is the empty text: one end symbol. Null or repeated ids are scored row by row.
With no training texts all symbols are equal (1/256). An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netpulse.llm.common import block_count, id_text, in_blocks, written
from netpulse.llm.textops import U64, Hasher, slices

ORDER = 5  # context bytes
END = 10  # the end symbol: a byte that no word holds
LOG10 = np.log(10.0)
WORD, STRING = 0, 1
BLOCK = 14 << 20  # bytes of text in a block


def stream(hasher: Hasher, buf: np.ndarray, off: np.ndarray, order: int):
    """(strings, row of each symbol, word hashes, row of each word) of a batch of texts."""
    n_rows = len(off) - 1
    # one end symbol after every text: each word is then followed by a byte that can hold its separator
    size = np.diff(off)
    place = np.arange(len(buf)) + np.repeat(np.arange(n_rows), size)
    full = np.full(len(buf) + n_rows, END, np.uint8)
    full[place] = buf
    off = off + np.arange(n_rows + 1)
    start, end, row, h = hasher.located_words(full, off)
    keep = ~hasher.space[full]
    keep[end] = True
    last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    full = hasher.lower[full]
    full[end[~last]] = 32
    full[end[last]] = END
    empty = np.bincount(row, minlength=n_rows) == 0
    keep[off[1:][empty] - 1] = True
    kept = np.concatenate([[0], np.cumsum(keep)])[off]
    rows = np.repeat(np.arange(n_rows), np.diff(kept))
    # before every text the context is end symbols; a string is read as the upper bytes of eight
    at = np.arange(kept[-1]) + order * (rows + 1)
    padded = np.full(8 + len(at) + order * n_rows, END, np.uint8)
    padded[at + 8] = full[keep]
    words = np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))
    strings = words[at + 1].astype(U64) & U64((1 << (8 * (order + 1))) - 1)
    return strings, rows, h, row


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[first], np.add.reduceat(n, first)


class _Counts:
    """Sums by key, merged whenever the parts have grown large."""

    def __init__(self) -> None:
        self.keys, self.counts, self.size = [], [], 0

    def add(self, keys: np.ndarray, weight: int) -> None:
        u, n = np.unique(keys, return_counts=True)
        self.keys.append(u)
        self.counts.append(n * weight)
        self.size += len(u)
        if self.size > 500_000:
            k, n = self.done()
            self.keys, self.counts, self.size = [k], [n], 0  # the merged part is counted when it is merged again

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        return _merge(self.keys, self.counts)


def _table_counts(table: pa.Table, hasher: Hasher, order: int):
    """Distinct words and strings of a block with their training counts, and its training tokens and texts."""
    train = ~table.column("held").to_numpy(zero_copy_only=False).astype(bool)
    found = {WORD: _Counts(), STRING: _Counts()}
    tokens = 0  # words and ends
    for a, b, buf, off in slices(table.column("text")):
        code, rows, h, row = stream(hasher, buf, off, order)
        here = train[a:b]
        tokens += int(here[row].sum()) + int(here.sum())
        for kind, keys, own in ((WORD, h, row), (STRING, code, rows)):
            trained = here[own]
            found[kind].add(keys[trained], 1)
            found[kind].add(keys[~trained], 0)
    return {k: v.done() for k, v in found.items()}, (tokens, int(train.sum()))


def _send(order: int):
    def run(table: pa.Table) -> pa.Table:
        counts, tokens = _table_counts(table, Hasher(), order)
        block = table.column("block")[0].as_py()
        parts = [(np.full(len(k), kind, np.int8), k.view(np.int64), n) for kind, (k, n) in counts.items()]
        parts.append((np.array([2, 3], np.int8), np.zeros(2, np.int64), np.array(tokens)))
        kind, key, n = (np.concatenate([p[i] for p in parts]) for i in range(3))
        pa.default_memory_pool().release_unused()
        return pa.table({"block": pa.array(np.full(len(key), block, np.int32)), "kind": pa.array(kind), "key": pa.array(key), "n": pa.array(n)})

    return run


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of positive counts, and their sums."""
    keep = counts > 0
    return _merge([keys[keep]], [counts[keep]]) if keep.any() else (np.zeros(0, U64), np.zeros(0, np.int64))


class _Order:
    """Contexts of one length: their keys, counts n, distinct symbols d, and each symbol's count."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.keys, self.counts = _sums(keys, counts)
        self.contexts, self.of = np.unique(self.keys >> U64(8), return_inverse=True)
        self.n = np.bincount(self.of, self.counts, len(self.contexts))
        self.d = np.bincount(self.of, minlength=len(self.contexts)).astype(float)

    def count(self, keys: np.ndarray) -> np.ndarray:
        return _find(self.keys, self.counts, keys)

    def context(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(seen, place) of the contexts of strings."""
        if not len(self.contexts):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        c = keys >> U64(8)
        at = np.minimum(np.searchsorted(self.contexts, c), len(self.contexts) - 1)
        return self.contexts[at] == c, at


def _find(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(asked))
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], 0)


def log_probabilities(strings: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int) -> np.ndarray:
    """log10 P(last byte | bytes before it) of distinct strings of ``order + 1`` bytes. All strings with
    training counts that share two context bytes must be there; ``pairs[c, s]`` counts all pairs."""
    low = np.flatnonzero(pairs.ravel())
    orders = [_Order(np.arange(256, dtype=U64), pairs.sum(0)), _Order(low.astype(U64), pairs.ravel()[low])]
    orders += [_Order(strings & U64((1 << (8 * (k + 1))) - 1), counts) for k in range(2, order + 1)]
    # what a context's symbols count in the next shorter context
    shared = [np.bincount(o.of, orders[k].count(o.keys & U64((1 << (8 * (k + 1))) - 1)), len(o.contexts))
              for k, o in enumerate(orders[1:])]
    out = np.zeros(len(strings))
    todo = np.arange(len(strings))
    out_n, out_d = np.zeros(len(strings)), np.zeros(len(strings))  # excluded counts and symbols
    for k in range(order, -1, -1):
        o = orders[k]
        key = strings[todo] & U64((1 << (8 * (k + 1))) - 1)
        seen, at = o.context(key)
        n = np.where(seen, o.n[at] if len(o.n) else 0, 0) - out_n[todo]
        d = np.where(seen, o.d[at] if len(o.d) else 0, 0) - out_d[todo]
        c = o.count(key)
        total = n
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(c > 0, np.log((c - 0.5) / total), np.where(seen & (total > 0), np.log(d / (2 * total)), 0.0))
        out[todo] += step
        if k:
            out_n[todo] = np.where(seen, shared[k - 1][at] if len(o.n) else 0, 0)
            out_d[todo] = np.where(seen, o.d[at] if len(o.d) else 0, 0)
        todo = todo[c == 0]
    known = int((pairs.sum(0) > 0).sum())
    out[todo] -= np.log(256 - known) if known < 256 else 0.0
    return out / LOG10


def _probabilities(pairs: np.ndarray, order: int):
    """(key, value) of every string of a partition that holds whole groups of two context bytes."""

    def run(batches):
        keys, counts = [], []
        for batch in batches:
            keys.append(batch.column("key").to_numpy().view(U64))
            counts.append(batch.column("n").to_numpy())
        if keys:
            k, n = np.concatenate(keys), np.concatenate(counts)
            value = log_probabilities(k, n, pairs, order)
            for a in range(0, len(k), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[a : a + 100_000].view(np.int64)), pa.array(value[a : a + 100_000])], ["key", "value"])

    return run


class _Lookup:
    """Values by key: keys are dealt into buckets by a multiplicative hash, a few probes find each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = U64(64 - max(1, int(4 * len(keys) + 1).bit_length()))
        bucket = self._bucket(keys)
        order = np.argsort(bucket, kind="stable")
        self.keys, self.values = np.append(keys[order], U64(0)), np.append(values[order], 0.0)
        number = np.bincount(bucket, minlength=1 << int(U64(64) - self.bits))
        self.most = int(number.max(initial=0))
        self.start = np.concatenate([[0], np.cumsum(number)]).astype(np.int32)

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * U64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys, 0 where there is none."""
        at = self.start[self._bucket(keys)]
        hit = self.keys[at] == keys
        out = np.where(hit, self.values[at], 0.0)
        todo = np.flatnonzero(~hit)
        for k in range(1, self.most):
            place = np.minimum(at[todo] + k, len(self.keys) - 1)
            hit = self.keys[place] == keys[todo]
            out[todo[hit]] = self.values[place[hit]]
            todo = todo[~hit]
        return out


def _score(order: int, train_tokens: int, train_texts: int, distinct: int):
    """Per text of a block: counts and scores, from the answers (kind, key, value)."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        hasher = Hasher()
        kind, key, value = (answers.column(c).to_numpy() for c in ("kind", "key", "value"))
        key = key.view(U64)
        known = {k: _Lookup(key[kind == k], value[kind == k]) for k in (WORD, STRING)}
        base = np.log10(train_tokens + distinct + 1.0)
        out = []
        for a, b, buf, off in slices(texts.column("text")):
            code, rows, h, row = stream(hasher, buf, off, order)
            n, m = known[WORD].get(h), b - a
            logs = known[STRING].get(code)
            tokens = np.bincount(row, minlength=m) + 1
            met = np.bincount(row, n > 0, m).astype(np.int64) + (train_texts > 0)
            out.append((tokens, met, np.bincount(row, np.log10(n + 1.0), m) + np.log10(train_texts + 1.0) - tokens * base,
                        np.bincount(rows, logs, m)))
        cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(4)]
        return pa.table([texts.column("doc_id"), texts.column("held"), pa.array(cols[0].astype(np.int64)),
                         pa.array(cols[1].astype(np.int64)), pa.array(np.full(len(cols[0]), train_tokens, np.int64)),
                         pa.array(cols[2]), pa.array(cols[3])],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def text_scores(docs: DataFrame, held_out: Column, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every whole text by a model of the texts for which ``held_out`` (of doc_id) is false."""
    texts = id_text(docs, id_col, text_col)
    texts = in_blocks(texts, block_count(texts, BLOCK)).withColumn("held", held_out)
    sent = written(texts.groupBy("block").applyInArrow(_send(order), "block int, kind byte, key long, n long"), "ppm-counts")
    words, strings = sent.where(F.col("kind") == WORD), sent.where(F.col("kind") == STRING)
    totals = sent.where("kind >= 2").groupBy("kind").agg(F.sum("n").alias("n")).collect()
    totals = {r["kind"]: r["n"] for r in totals}
    train_tokens, train_texts = totals.get(2, 0), totals.get(3, 0)

    # words: the training count over all blocks; a word that no training text holds needs no answer
    word_counts = words.withColumn("all", F.sum("n").over(Window.partitionBy("key"))).where("all > 0")
    word_counts = written(word_counts.select("block", "key", F.col("all").cast("double").alias("value")), "ppm-words")
    distinct = word_counts.select("key").distinct().count() + (train_texts > 0)

    # strings: one row each, scored with all strings of its last two context bytes
    model = written(strings.groupBy("key").agg(F.sum("n").alias("n")), "ppm-strings")
    pairs = np.zeros((256, 256))
    low = model.groupBy(F.pmod("key", F.lit(1 << 16)).alias("pair")).agg(F.sum("n").alias("n"))  # at most 65,536 rows
    for r in low.collect():
        pairs[r["pair"] >> 8, r["pair"] & 255] = r["n"]
    near = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF))
    logs = model.repartition(near).mapInArrow(_probabilities(pairs, order), "key long, value double")
    answers = strings.select("block", "key").join(logs, "key").select("block", F.lit(STRING).cast("byte").alias("kind"), "key", "value")
    answers = answers.unionByName(word_counts.select("block", F.lit(WORD).cast("byte").alias("kind"), "key", "value"))
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _score(order, train_tokens, train_texts, distinct), SCORES)
