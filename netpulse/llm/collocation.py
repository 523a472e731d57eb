"""Phrase collocation mining: frequent phrases of 2 to 5 words that occur together more often than apart.

A text is cut at ``[.,;:!?]`` and line ends into pieces, a piece into words. Every word begins a suffix: a pointer
to it and the words that follow in its piece, up to the greatest phrase length. Counts of phrases come
from sorting these pointers (multikey three-way quicksort):

* A block of texts sends its distinct suffixes with their numbers, as rows of codes with the block's words beside
  them, to the bucket of their leading words; copies within a block are one suffix with a weight.
* A bucket partitions its pointers into smaller, equal and larger ones around a pivot word, again and again; the equal
  ones go on at the next word. The weight of an equal partition at depth d is the count of the phrase of its
  first d words. A partition that weighs less than ``min_count`` is abandoned: no phrase in it can be frequent.
  All partitions of a bucket are worked on together, one pass of array operations for each step.
* Suffixes are routed by their first word, below a heavy word by their first two, and so on: a prefix is heavy where it has
  more than half a bucket's share of a sample of the texts. The sample decides only where a suffix goes; counts of heavy
  prefixes are added up by the blocks, and all texts are counted.

A phrase's score is the lowest over its cuts in two: floor(1000 * a * n / (l * r)), with a the count of the phrase,
l and r those of its two parts and n all words of the language, in decimals wide enough to be exact. A candidate
goes where a phrase one word longer contains it and is as frequent; phrases longer by more are at most as frequent
as one between, so these need no look.

Nulls: a null text is the empty text, a null language is ``und``. Rows count one by one, whatever their ids
(repeated or null). Words are compared as bytes. Texts without words and an empty table give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netpulse.llm.common import materialize, text_bytes
from netpulse.llm.textops import U64, Hasher, buffers, mix
from netpulse.llm.textruns import BLANK, LOWER, PIECE_END, coded, gathered, lines, packed, runs, sums, text_codes, unpacked
from netpulse.session import small

MIN_COUNT, LONGEST, TOP = 100, 5, 2000
BLOCK, BUCKET = 8 << 20, 8 << 20  # bytes of text whose suffixes a block collects, and a bucket sorts
SAMPLE = 8 << 20  # bytes of text that heavy prefixes are looked for in, and 4 KB more a bucket
RANGE = 1 << 20  # words coded together: their codes take 21 bits
_CODE = 21


def collocation_rows(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


class Suffixes:
    """The distinct suffixes of a range of words, sorted, with their weights.

    ``keys`` has a row for the language and one for each word: codes from 1, 0 after a piece's end."""

    def __init__(self, codes: np.ndarray, words: pa.Array, lang: np.ndarray, langs: list[str], left: np.ndarray, longest: int) -> None:
        n = len(left)
        column = [np.where(left > j, np.append(codes[j:], np.zeros(j, codes.dtype))[:n] + 1, 0).astype(np.int32) for j in range(longest)]
        packs = [lang.astype(np.int64) + 1]
        for j, c in enumerate(column):  # three codes to a long
            if j % 3 == 2:
                packs.append(c.astype(np.int64))
            else:
                packs[-1] = packs[-1] << _CODE | c
        order = np.lexsort(packs[::-1])
        packs = [p[order] for p in packs]
        new = np.append(True, np.any([p[1:] != p[:-1] for p in packs], axis=0)) if n else np.zeros(0, bool)
        first = np.flatnonzero(new)
        self.weight = np.diff(np.append(first, n))
        at = order[first]
        self.keys = np.stack([lang[at].astype(np.int32) + 1, *[c[at] for c in column]])
        self.words, self.langs, self.longest = words, langs, longest

    def prefixes(self, hasher: Hasher) -> Iterator[np.ndarray]:
        """For every depth from 1 a hash of the language and as many leading words (of no use beyond a piece's end)."""
        word = mix(_hashes(hasher, self.words), 2)
        language = _hashes(hasher, pa.array(self.langs, pa.string()))
        h = mix(language[self.keys[0] - 1], 1)
        for j in range(1, self.longest + 1):
            h = mix(h + word[np.maximum(self.keys[j], 1) - 1], j + 2)
            yield h

    def groups(self, depth: int) -> np.ndarray:
        """Where the runs of suffixes that agree in language and ``depth`` words begin."""
        k = self.keys[: depth + 1]
        return np.flatnonzero(np.append(True, (k[:, 1:] != k[:, :-1]).any(axis=0))) if k.shape[1] else np.zeros(0, np.int64)

    def phrase(self, at: int, depth: int) -> str:
        return " ".join(self.words[int(self.keys[j, at]) - 1].as_py().decode() for j in range(1, depth + 1))


def _hashes(hasher: Hasher, values: pa.Array) -> np.ndarray:
    buf, off = buffers(values)
    return hasher._hash(buf, off[:-1], off[1:]) if len(off) > 1 else np.zeros(0, U64)


def block_suffixes(batches, longest: int) -> Iterator[Suffixes]:
    for table in gathered(batches, BLOCK):
        buf, off = buffers(table.column("text"))
        buf = LOWER[buf]
        solid = ~(BLANK | PIECE_END)[buf]
        start, end, row = runs(solid, off)
        n = len(start)
        if not n:
            continue
        piece = np.searchsorted(np.flatnonzero(PIECE_END[buf]), start)
        last = np.flatnonzero(np.append((row[1:] != row[:-1]) | (piece[1:] != piece[:-1]), True))  # words that close a piece
        left = np.minimum(last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1, longest).astype(np.uint8)
        lang, langs = text_codes(table.column("lang"))
        lang = lang[row]
        at = np.append(0, np.cumsum(end - start))  # places in the words' bytes alone
        flat = buf[solid]
        del table, buf, solid, start, end, row, piece, last
        for a in range(0, n, RANGE):
            b, c = min(n, a + RANGE), min(n, a + RANGE + longest - 1)  # the last words' followers belong to the next range too
            codes, words = coded(flat, np.s_[at[a] : at[c]], at[a:c], at[a + 1 : c + 1])
            yield Suffixes(codes, words, lang[a:b], langs, left[a:b], longest)


def _count_prefixes(longest: int):
    """(depth, prefix, n) of the blocks' suffixes, for the depths that a suffix can be routed by; depth 0: all."""

    def run(batches):
        hasher = Hasher()
        for s in block_suffixes(batches, longest):
            found = [(0, np.zeros(1, np.int64), np.array([s.weight.sum()]))]
            for d, h in enumerate(s.prefixes(hasher), 1):
                if d == longest:
                    break
                there = s.keys[d] > 0
                key, n = sums(h[there].view(np.int64), s.weight[there])
                found.append((d, key, n))
            for d, key, n in found:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), d, np.int32)), pa.array(key), pa.array(n)], ["depth", "prefix", "n"])

    return run


def heavy_prefixes(rows: DataFrame, size: int, buckets: int, longest: int) -> list[np.ndarray]:
    """Sorted hashes of the heavy prefixes of every depth below ``longest``: those with over half a bucket's share of a sample.
    By that share there are at most 2 * ``buckets`` of a depth, so this list has a bound."""
    every = max(1, size // (SAMPLE + 4096 * buckets))
    sample = rows.where(F.pmod(F.xxhash64("text", "lang"), F.lit(every)) == 0)
    counts = sample.mapInArrow(_count_prefixes(longest), "depth int, prefix long, n long").groupBy("depth", "prefix").agg(F.sum("n").alias("n"))
    counts = materialize(counts)
    total = (counts.where("depth = 0").first() or [0, 0, 0])[2]
    found = counts.where((F.col("depth") > 0) & (2 * buckets * F.col("n") > total)).collect()
    return [np.sort(np.array([r["prefix"] for r in found if r["depth"] == d], np.int64).view(U64)) for d in range(1, longest)]


def _in(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)] == values


ROUTED = "bucket int, lang string, phrase string, m int, n long, langs string, size long, data binary"
_ARROW = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("phrase", pa.string()), ("m", pa.int32()), ("n", pa.int64()),
                    ("langs", pa.string()), ("size", pa.int64()), ("data", pa.binary())])


def _route(heavy: list[np.ndarray], buckets: int, longest: int):
    """Rows to the buckets: packed suffixes, and counts of languages (m = 0) and heavy prefixes."""

    def run(batches):
        hasher = Hasher()
        for s in block_suffixes(batches, longest):
            out = []

            def count(depth: int, at: int, n: int, h: int, out=out, s=s) -> None:
                out.append({"bucket": int(h % buckets), "lang": s.langs[int(s.keys[0, at]) - 1], "phrase": s.phrase(at, depth), "m": depth, "n": int(n)})

            at = s.groups(0)
            for i, n in zip(at.tolist(), np.add.reduceat(s.weight, at).tolist(), strict=True):
                count(0, i, n, i)
            depth = np.ones(len(s.weight), np.uint8)  # by how many words a suffix is routed; 0: it has no more
            heavier = np.ones(len(s.weight), bool)
            to = np.zeros(len(s.weight), np.int64)
            for d, h in enumerate(s.prefixes(hasher), 1):
                to[heavier] = (h[heavier] % U64(buckets)).astype(np.int64)
                if d == longest:
                    break
                heavier &= _in(heavy[d - 1], h)
                if not heavier.any():
                    break
                at = s.groups(d)
                total = np.add.reduceat(s.weight, at)
                for i in np.flatnonzero(heavier[at]).tolist():
                    count(d, int(at[i]), int(total[i]), int(h[at[i]]))
                depth[heavier] = np.where(s.keys[d + 1][heavier] > 0, d + 1, 0)
                heavier &= depth > 0
            sent = np.flatnonzero(depth)
            sent = sent[np.argsort(to[sent], kind="stable")]
            cut = np.flatnonzero(np.append(True, to[sent][1:] != to[sent][:-1])) if len(sent) else np.zeros(0, np.int64)
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(sent)], strict=True):
                rows = sent[a:b]
                used, back = np.unique(np.append(0, s.keys[1:, rows]), return_inverse=True)
                code = back[1:].reshape(longest, -1).astype(np.min_scalar_type(len(used)))
                words = b"\n".join(s.words.take(pa.array(used[1:] - 1)).to_pylist())
                data, size = packed([np.frombuffer(words, np.uint8), s.keys[0, rows].astype(np.uint32), *code, s.weight[rows].astype(np.int64), depth[rows]])
                out.append({"bucket": int(to[rows[0]]), "langs": json.dumps(s.langs), "size": size, "data": data})
            yield pa.RecordBatch.from_pylist(out, _ARROW)

    return run


def frequent_prefixes(keys: np.ndarray, weight: np.ndarray, least: int):
    """Multikey three-way quicksort of the pointers 0 .. n - 1 by ``keys`` (a row for each depth; 0 ends a key), to the maximum depth.

    Yields (depth, pointers, weights): a pointer into each equal partition of at least ``least`` at that depth, and its
    weight. A step partitions every open part around its own pivot; a part below ``least`` is abandoned."""
    pointer = np.arange(keys.shape[1])
    size = np.array([len(pointer)])
    depth = np.zeros(1, np.int64)
    if weight.sum() < least:
        return
    while len(size):
        start = np.cumsum(size) - size
        part = np.repeat(np.arange(len(size)), size)
        value = keys[np.repeat(depth, size), pointer]
        low, mid, high = value[start], value[start + size // 2], value[start + size - 1]
        pivot = np.maximum(np.minimum(low, mid), np.minimum(np.maximum(low, mid), high))
        beside = value - np.repeat(pivot, size)
        side = part * 3 + (np.sign(beside) + 1)
        total = np.bincount(side, weight[pointer], 3 * len(size)).astype(np.int64)  # exact below 2**53
        count = np.bincount(side, minlength=3 * len(size))
        equal = np.tile([False, True, False], len(size))
        level = np.repeat(depth, 3) + equal
        kept = (total >= least) & ~(equal & (np.repeat(pivot, 3) == 0))
        # abandoned partitions leave before the others are put in order
        here = kept[side]
        pointer, side = pointer[here], side[here]
        pointer = pointer[np.argsort(side, kind="stable")]
        count, total, level, equal = count[kept], total[kept], level[kept], equal[kept]
        begin = np.cumsum(count) - count
        for d in np.unique(level[equal]).tolist():
            found = equal & (level == d)
            yield d, pointer[begin[found]], total[found]
        more = level < len(keys)
        pointer = pointer[np.repeat(more, count)]
        size, depth = count[more], level[more]


FOUND = "lang string, phrase string, m int, n long"


def _sort(least: int, longest: int):
    """A bucket: frequent phrases with their counts; counts made by the blocks pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        words, keys, weight, depth = [], [], [], []
        passed = []
        for batch in batches:
            for r in batch.to_pylist():
                if r["data"] is None:
                    passed.append({k: r[k] for k in ("lang", "phrase", "m", "n")})
                    continue
                text, lang, *code, w, d = unpacked(r["data"], r["size"])
                here = np.array([0] + [langs.setdefault(x, len(langs) + 1) for x in json.loads(r["langs"])], np.int32)
                words.append(lines(text))
                keys.append(np.stack([here[lang], *code]).astype(np.int32))
                weight.append(w)
                depth.append(d)
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("m", pa.int32()), ("n", pa.int64())])
        yield pa.RecordBatch.from_pylist(passed, schema)
        if not words:
            return
        every = pa.concat_arrays(words).dictionary_encode()
        index, names = every.indices.to_numpy() + 1, every.dictionary
        at = 0
        for w, k in zip(words, keys, strict=True):
            own = np.append(0, index[at : at + len(w)]).astype(np.int32)
            k[1:] = own[k[1:]]
            at += len(w)
        keys, weight, depth = np.concatenate(keys, axis=1), np.concatenate(weight), np.concatenate(depth)
        listed = list(langs)
        for d, pointers, total in frequent_prefixes(keys, weight, least):
            whole = (depth[pointers] <= d - 1) & (d > 1)  # less deep ones have other rows elsewhere: the blocks have counted them
            if not whole.any():
                continue
            pointers, total = pointers[whole], total[whole]
            parts = [names.take(pa.array(keys[j, pointers] - 1)).to_pylist() for j in range(1, d)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([listed[x - 1] for x in keys[0, pointers].tolist()], pa.string()),
                 pa.array([b" ".join(p).decode() for p in zip(*parts, strict=True)], pa.string()),
                 pa.array(np.full(len(pointers), d - 1, np.int32)), pa.array(total)], schema=schema)

    return run


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, m, n): how often each phrase of m words occurs, from ``min_count`` times on; m = 0: all words of the language."""
    rows = collocation_rows(docs)
    size = text_bytes(rows)
    buckets = max(1, -(-size // BUCKET), min(rows.sparkSession.sparkContext.defaultParallelism, size // (1 << 20)))
    heavy = heavy_prefixes(rows, size, buckets, longest)
    routed = rows.mapInArrow(_route(heavy, buckets, longest), ROUTED)
    found = routed.groupBy("bucket").applyInArrow(_sort(min_count, longest), FOUND)
    # a heavy prefix has a row from every block, any other phrase one
    counts = found.groupBy("lang", "phrase", "m").agg(F.sum("n").alias("n"))
    return materialize(counts.where((F.col("m") == 0) | (F.col("n") >= min_count)))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP, absorb_percent: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of each language. Phrases go where a longer frequent
    one holds them and has at least ``absorb_percent`` per cent of their count."""
    counts = phrase_counts(docs, min_count, longest)
    totals = small(counts.where("m = 0").select("lang", F.col("n").alias("words")))
    phrases = counts.where("m > 0")
    words = F.split("phrase", " ")

    def part(start, length):
        return F.array_join(F.slice(words, start, length), " ")

    candidates = phrases.where("m > 1").select("lang", "phrase", "m", F.col("n").alias("a"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(1, F.col("k")).alias("first"), part(F.col("k") + 1, F.col("m") - F.col("k")).alias("rest"))
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(phrases.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(cast(1000 as decimal(4,0)) * cast(a as decimal(18,0)) * cast(words as decimal(16,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score.alias("score"), "k", "l", "r", "a", F.col("words").alias("n"))).alias("best"))
    scored = scored.select("lang", "phrase", "best.*")

    longer = phrases.where("m > 2").select("lang", F.explode(F.array(part(1, F.col("m") - 1), part(2, F.col("m") - 1))).alias("phrase"), "n")
    longer = longer.groupBy("lang", "phrase").agg(F.max("n").alias("within"))
    scored = scored.join(longer, ["lang", "phrase"], "left").where(
        F.col("within").isNull() | (100 * F.col("within") < absorb_percent * F.col("a")))
    # the best of parts of a language first, so that no task ranks a whole language
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    scored = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    for keys in (("lang", "part"), ("lang",)):
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
    return scored.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *[F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")])
