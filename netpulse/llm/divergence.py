"""Source divergence audit: how the term frequencies of each (lang, source) group differ.

Terms are runs of letters and non-ASCII characters, A-Z lower-cased. Every language keeps the terms that at
least ``min_docs`` of its documents hold. A group, and a language as a whole, gives each of the V kept terms
p = 1 + floor(10**9 * (count + 5) / (N + 5 V)), N being its occurrences of kept terms. Part ``pair`` has the
sum of absolute differences of p over all kept terms for every two sources of a language, part ``term`` the
``top`` terms of a group that lie above their language.

Strings are materialized late:
* A scan of the texts writes, for every block and digest range, packed 64-bit term digests with counts by
  group and document counts by language, and apart from them the block's dictionary (digests and strings).
* Only the packed digests are shuffled; a range adds its blocks up and keeps what reaches ``min_docs``.
  Terms that share a digest are counted together here, so no term that should be kept is lost.
* Dictionaries are read with a bitmap of the kept digests (8 MB at most; it lets a few others through, which
  a join removes), and each kept digest gets its smallest and largest string. Where these differ, the
  digest holds several terms: its terms are counted again by string from the texts, and take its place.
* Differences are summed by (lang, range of digests). Text joins back for the ranked terms only; all those that
  tie at the last rank are named before the cut.

Nulls: null text, lang and source are the empty text. Rows count one by one, whatever their ids (repeated
or null). Groups whose texts hold no term take part with counts of 0; a language without kept terms
has pairs of value 0 and no terms. An empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netpulse.llm.common import block_count, materialize, written
from netpulse.llm.textops import U64, Hasher, buffers
from netpulse.llm.textruns import LETTER, LOWER, coded, gathered, hash_filter, packed, passes, runs, sums, text_codes, unpacked
from netpulse.session import small

MIN_DOCS, TOP = 30, 50
SCALE, PRIOR = 1_000_000_000, 5  # fixed values of the contract
BLOCK = 16 << 20  # bytes of text counted at once
SOURCES = 1024  # sources compared at once in a task
COUNTS, NAMES = 0, 1


def audit_rows(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    return docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n)
                         for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])


def term_digests(hasher: Hasher, terms: pa.Array, bits: int) -> np.ndarray:
    buf, off = buffers(terms)
    h = hasher._hash(buf, off[:-1], off[1:]) if len(off) > 1 else np.zeros(0, U64)
    return h >> U64(64 - bits)


class _Block:
    """Terms of a table of rows: counts of (row, term) pairs, and the dictionary."""

    def __init__(self, table: pa.Table, hasher: Hasher, bits: int) -> None:
        buf, off = buffers(table.column("text"))
        buf = LOWER[buf]
        solid = LETTER[buf]
        start, end, row = runs(solid, off)
        codes, self.terms = coded(buf, solid, start, end)
        self.width = max(1, len(self.terms))
        pair, self.count = np.unique(row * self.width + codes, return_counts=True)
        self.row, self.term = pair // self.width, pair % self.width
        self.digest = term_digests(hasher, self.terms, bits)
        self.lang, self.langs = text_codes(table.column("lang"))
        self.source, self.sources = text_codes(table.column("source"))


def _scan(parts: int, bits: int):
    """(kind, part, lang, names, size, data): a block's counts by digest range and language, and its dictionary.
    ``names`` are the sources that counts refer to, or the dictionary's terms."""
    bounds = np.array([((1 << bits) * p) // parts for p in range(parts)] + [(1 << bits) - 1], U64)

    def run(batches):
        hasher = Hasher()
        for table in gathered(batches, BLOCK):
            b = _Block(table, hasher, bits)
            out = []
            if not len(b.terms):
                continue
            order = np.argsort(b.digest, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            digest = b.digest[order]
            cut = np.searchsorted(digest, bounds)
            cut[-1] = len(digest)
            # per language and term the number of documents, per (language, source) and term the occurrences
            place, lang = rank[b.term], b.lang[b.row].astype(np.int64)
            docs_key, docs = sums(lang * b.width + place, np.ones(len(place), np.int64))
            n_sources = len(b.sources)
            key, n = sums((lang * b.width + place) * n_sources + b.source[b.row], b.count.astype(np.int64))
            term_key, src = key // n_sources, (key % n_sources).astype(np.int32)
            names = json.dumps(b.sources)
            for x, language in enumerate(b.langs):
                for p in range(parts):
                    lo, hi = (np.searchsorted(docs_key, x * b.width + c) for c in (cut[p], cut[p + 1]))
                    if lo == hi:
                        continue
                    u, v = np.searchsorted(term_key, [docs_key[lo], docs_key[hi - 1] + 1])
                    each = np.diff(np.append(np.searchsorted(term_key[u:v], docs_key[lo:hi]), v - u)).astype(np.int32)
                    data, size = packed([digest[docs_key[lo:hi] - x * b.width], docs[lo:hi].astype(np.int32), each, src[u:v], n[u:v].astype(np.int32)])
                    out.append((COUNTS, p, language, names, size, data))
            terms = b.terms.take(pa.array(order)).to_pylist()
            data, size = packed([digest])
            out.append((NAMES, -1, None, b"\n".join(terms).decode(), size, data))
            yield pa.RecordBatch.from_pylist([dict(zip(STORED, r, strict=True)) for r in out], STORED_ARROW)

    return run


STORED = ("kind", "part", "lang", "names", "size", "data")
STORED_SCHEMA = "kind int, part int, lang string, names string, size long, data binary"
STORED_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("lang", pa.string()), ("names", pa.string()),
                          ("size", pa.int64()), ("data", pa.binary())])
KEPT_SCHEMA = "lang string, source string, digest long, sub int, n long, total long"


def _add_up(min_docs: int):
    """A digest range: blocks are added up per language; kept digests with their occurrences in each source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                held.setdefault(r["lang"], []).append((r["names"], r["size"], r["data"]))
        for lang, blocks in held.items():
            names: dict[str, int] = {}
            digests, docs, at, src, n = [], [], [], [], []
            for listed, size, data in blocks:
                d, df, each, s, c = unpacked(data, size)
                index = np.array([names.setdefault(x, len(names)) for x in json.loads(listed)], np.int64)
                digests.append(d)
                docs.append(df.astype(np.int64))
                at.append(np.repeat(d, each))
                src.append(index[s])
                n.append(c.astype(np.int64))
            digest, df = sums(np.concatenate(digests), np.concatenate(docs))
            digest = digest[df >= min_docs]
            at, src, n = np.concatenate(at), np.concatenate(src), np.concatenate(n)
            place = np.searchsorted(digest, at)
            here = place < len(digest)
            here[here] = digest[place[here]] == at[here]
            key, count = sums(place[here] * len(names) + src[here], n[here])
            term = key // len(names)
            total = np.zeros(len(digest), np.int64)
            np.add.at(total, term, count)
            which = pa.array(list(names))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(key), pa.string()), which.take(pa.array(key % len(names))), pa.array(digest[term].view(np.int64)),
                 pa.array(np.zeros(len(key), np.int32)), pa.array(count), pa.array(total[term])],
                ["lang", "source", "digest", "sub", "n", "total"])

    return run


def _names(batches):
    """(digest, term) of the stored dictionaries; the strings of a block are distinct."""
    for batch in batches:
        for r in batch.to_pylist():
            (digest,) = unpacked(r["data"], r["size"])
            terms = pa.array(r["names"].split("\n"))
            for a in range(0, len(digest), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(digest[a : a + 100_000].view(np.int64)), terms.slice(a, 100_000)], ["digest", "term"])


def _recount(bits: int):
    """(lang, source, digest, term, n, docs) of a block's terms."""

    def run(batches):
        hasher = Hasher()
        for table in gathered(batches, BLOCK):
            b = _Block(table, hasher, bits)
            if not len(b.terms):
                continue
            lang, source = b.lang[b.row].astype(np.int64), b.source[b.row]
            key = (lang * len(b.sources) + source) * b.width + b.term
            _, docs = sums(key, np.ones(len(key), np.int64))
            key, n = sums(key, b.count.astype(np.int64))
            group, term = key // b.width, key % b.width
            terms = b.terms.cast(pa.string())
            for a in range(0, len(key), 100_000):
                s = slice(a, a + 100_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b.langs).take(pa.array(group[s] // len(b.sources))), pa.array(b.sources).take(pa.array(group[s] % len(b.sources))),
                     pa.array(b.digest[term[s]].view(np.int64)), terms.take(pa.array(term[s])), pa.array(n[s]), pa.array(docs[s])],
                    ["lang", "source", "digest", "term", "n", "docs"])

    return run


def kept_terms(rows: DataFrame, min_docs: int = MIN_DOCS, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """((lang, source, digest, sub, n, total), (digest, sub, term)): occurrences of every kept term by group and in its
    language, and the terms. ``sub`` tells terms of one digest apart."""
    parts = block_count(rows, BLOCK)
    stored = written(rows.mapInArrow(_scan(parts, bits), STORED_SCHEMA), "divergence-blocks")
    counts = stored.where(F.col("kind") == COUNTS).select("part", "lang", "names", "size", "data")
    kept = materialize(counts.groupBy("part").applyInArrow(_add_up(min_docs), KEPT_SCHEMA))
    digests = small(kept.select("digest").distinct())
    names = stored.where(F.col("kind") == NAMES).select("names", "size", "data").mapInArrow(
        _filtered(_names, hash_filter(digests)), "digest long, term string")
    names = materialize(names.join(digests, "digest", "left_semi").groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high")))
    several = names.where("low <> high").select("digest")
    if several.isEmpty():
        return kept, names.select("digest", F.lit(0).alias("sub"), F.col("low").alias("term"))
    several = small(several)
    again = rows.mapInArrow(_filtered(_recount(bits), hash_filter(several)), "lang string, source string, digest long, term string, n long, docs long")
    again = again.join(several, "digest", "left_semi").groupBy("lang", "source", "digest", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    again = materialize(again)
    of_lang = again.groupBy("lang", "digest", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
    terms = materialize(of_lang.select("digest", "term").distinct().withColumn(
        "sub", F.row_number().over(Window.partitionBy("digest").orderBy("term"))))
    split = again.drop("docs").join(of_lang.drop("docs"), ["lang", "digest", "term"]).join(terms, ["digest", "term"])
    kept = materialize(kept.join(several, "digest", "left_anti").unionByName(split.select("lang", "source", "digest", "sub", "n", "total")))
    single = names.where("low = high").select("digest", F.lit(0).alias("sub"), F.col("low").alias("term"))
    return kept, single.unionByName(terms.select("digest", "sub", "term"))


def _filtered(made, bitmap: np.ndarray):
    """``made``'s rows whose digest passes the bitmap."""

    def run(batches):
        for batch in made(batches):
            yield batch.filter(pa.array(passes(bitmap, batch.column("digest").to_numpy())))

    return run


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of a language's terms: for every two of its sources the sum of |p - p'| over the range. Rows without a
    digest list the sources with their p of a term they lack."""
    table = pa.Table.from_batches(list(batches))
    lang = table.column("lang")[0].as_py()
    listed = table.filter(pc.is_null(table.column("digest")))
    data = table.filter(pc.is_valid(table.column("digest")))
    names = sorted(listed.column("source").to_pylist())
    index = {s: i for i, s in enumerate(names)}
    zero = np.zeros(len(names), np.int64)
    zero[[index[s] for s in listed.column("source").to_pylist()]] = listed.column("p").to_numpy()
    codes, found = text_codes(data.column("source"))
    src = np.array([index[s] for s in found], np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
    pair = np.stack([data.column("digest").to_numpy(), data.column("sub").to_numpy()], 1) if len(codes) else np.zeros((0, 2), np.int64)
    _, term = np.unique(pair, axis=0, return_inverse=True)
    term = term.ravel()
    p = data.column("p").to_numpy()
    order = np.argsort(term, kind="stable")
    term, src, p = term[order], src[order], p[order]
    n_terms = int(term[-1]) + 1 if len(term) else 0
    tile = max(1, (1 << 21) // min(SOURCES, len(names)))

    def dense(a: int, t: int) -> np.ndarray:
        lo, hi = np.searchsorted(term, [t, t + tile])
        here = (src[lo:hi] >= a) & (src[lo:hi] < a + SOURCES)
        out = np.repeat(zero[None, a : a + SOURCES], min(tile, n_terms - t), axis=0)
        out[term[lo:hi][here] - t, src[lo:hi][here] - a] = p[lo:hi][here]
        return out

    for a in range(0, len(names), SOURCES):
        for b in range(a, len(names), SOURCES):
            total = np.zeros((min(SOURCES, len(names) - a), min(SOURCES, len(names) - b)), np.int64)
            for t in range(0, n_terms, tile):
                left = dense(a, t)
                right = left if a == b else dense(b, t)
                for i in range(left.shape[1]):
                    total[i] += np.abs(right - left[:, i : i + 1]).sum(0)
            i, j = np.nonzero(np.ones_like(total)) if a != b else np.triu_indices(len(total), 1)
            which = pa.array(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(i), pa.string()), which.take(pa.array(i + a)), which.take(pa.array(j + b)), pa.array(total[i, j])],
                ["lang", "source", "item", "value"])


def _p(count, n, v):
    """1 + floor(SCALE * (count + PRIOR) / (n + PRIOR v)), exact."""
    return F.expr(f"1 + cast((cast({SCALE} as decimal(12,0)) * cast({count} + {PRIOR} as decimal(20,0))) div cast({n} + {PRIOR} * {v} as decimal(20,0)) as bigint)")


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank) as described above. ``bits`` is the width of a digest."""
    rows = audit_rows(docs)
    kept, terms = kept_terms(rows, min_docs, bits)
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"))
    # every (digest, sub) of a language once
    sizes = kept.select("lang", "digest", "sub").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    groups = rows.select("lang", "source").distinct()
    groups = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left")
    groups = groups.join(langs.join(sizes, "lang"), "lang", "left").na.fill(0, ["group_n", "lang_n", "v"])
    groups = small(groups)
    scored = kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "digest", "sub", _p("n", "group_n", "v").alias("p"), _p("total", "lang_n", "v").alias("q"))
    scored = materialize(scored)

    # pairs of sources, by ranges of their language's terms
    n = scored.count()
    buckets = max(1, -(-n // 250_000), min(kept.sparkSession.sparkContext.defaultParallelism, n // 25_000))
    zero = groups.select("lang", "source", F.lit(None).cast("long").alias("digest"), F.lit(0).alias("sub"),
                         F.when(F.col("v") > 0, _p("0", "group_n", "greatest(v, 1)")).otherwise(0).alias("p"),
                         F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"))
    data = scored.select("lang", "source", "digest", "sub", "p", F.pmod(F.xxhash64("digest", "sub"), F.lit(buckets)).cast("int").alias("bucket"))
    halves = data.unionByName(zero).groupBy("lang", "bucket").applyInArrow(_differences, "lang string, source string, item string, value long")
    halves = halves.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("source").alias("source"), F.col("item").alias("item")),
                             F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = halves.select("lang", both.alias("s"), "value").select("lang", "s.source", "s.item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))

    # terms above their language: best of every range, then of the group with all ties, then by text
    above = scored.where("p > q").select("lang", "source", "digest", "sub", (F.col("p") - F.col("q")).alias("value"))
    best = above.withColumn("bucket", F.pmod(F.xxhash64("digest", "sub"), F.lit(buckets)))
    for keys in (("lang", "source", "bucket"), ("lang", "source")):
        best = best.withColumn("place", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("value")))).where(F.col("place") <= top)
    best = best.join(terms, ["digest", "sub"]).select("lang", "source", F.col("term").alias("item"), "value")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank")]
    return pairs.select(*columns).unionByName(best.select(*columns))
