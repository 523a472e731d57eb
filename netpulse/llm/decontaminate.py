"""Benchmark decontamination: BM25 over an inverted index of the test items, with block-max WAND.

Words are runs of letters and digits, lower-cased. Test items are cut into chunks of at most
``CHUNK_WORDS`` words, the documents of a BM25 index; a chunk's impacts are divided by its score
against itself, so ``theta`` is a share of the whole. Every passage of every document (``WINDOW``
words, each half overlapping the next) is a query, and all chunks that reach ``theta`` are retrieved:
1. For all passages of a batch at once: of each chunk, the postings of least impact up to a
   share ``REST`` are not essential. Essential impacts are summed per half passage and chunk;
   only where two neighbouring halves reach ``theta - REST`` for some chunk can it be retrieved.
2. For the passages left, block-max WAND: cursors move along postings sorted by chunk; a pivot is scored only
   where the list maxima and then the maxima of the current blocks sum to ``theta``.

A retrieved chunk is verified in the passage and its surroundings: shares of the word 3-grams of
its question part and its answer part (columns of those names, or else the first two thirds and the
rest of the text) that occur there. A document is contaminated by an item when a chunk passes
both.

The index is made by DataFrame joins; items are dealt into shards of at most ``SHARD_BYTES`` of
text, and only one shard's index at a time is sent to the tasks.

Nulls: null or wordless items are never found; a null text is the empty text. Rows that repeat an
id are told apart by their text; identical rows give one result per item. No items or no documents, no rows.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netpulse.llm.common import id_text, materialize, text_key
from netpulse.llm.textops import U64, Hasher, mix, slices, starts

THETA, REST = 0.6, 0.2
WINDOW, CHUNK_WORDS = 64, 48
MIN_QUESTION, MIN_ANSWER = 0.6, 0.6
SHARD_BYTES = 16 << 20
K1, B = 1.2, 0.75
BLOCK = 16  # postings in a block


def _chunks(batches):
    """Per chunk of every item: its terms with counts, and the 3-grams of question and answer."""
    hasher = Hasher()
    for batch in batches:
        shard, item, name = (batch.column(c).to_pylist() for c in ("shard", "item_id", "row"))
        answer_at = batch.column("answer_at").to_pylist()
        out = []
        for a, b, buf, off in slices(batch.column("text"), 1 << 20):
            start, _, row, h = hasher.tokens(buf, off)
            at = starts(row, b - a)
            for r in range(b - a):
                words, where = h[at[r] : at[r + 1]], start[at[r] : at[r + 1]] - off[r]
                n = len(words)
                if not n:
                    continue
                cut = answer_at[a + r]
                cut = int((where < cut).sum()) if cut is not None else n - n // 3
                pieces = math.ceil(n / CHUNK_WORDS)
                for c in range(pieces):
                    lo, hi = n * c // pieces, n * (c + 1) // pieces
                    term, tf = np.unique(words[lo:hi], return_counts=True)
                    q, s = words[lo : min(hi, cut)], words[max(lo, cut) : hi]
                    out.append((shard[a + r], item[a + r], f"{name[a + r]}:{c}", hi - lo, term.view(np.int64), tf,
                                grams(q).view(np.int64), grams(s).view(np.int64)))
        if out:
            kinds = [pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), *[pa.list_(pa.int64())] * 2]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)],
                                             ["shard", "item_id", "chunk", "len", "terms", "tfs", "question", "answer"])


def grams(words: np.ndarray) -> np.ndarray:
    """Distinct hashes of word 3-grams (of the whole, if shorter)."""
    k = min(3, len(words))
    if not k:
        return np.zeros(0, U64)
    acc = np.zeros(len(words) - k + 1, U64)
    for j in range(k):
        acc += mix(words[j : len(words) - k + 1 + j], 90 + j + 10 * k)
    return np.unique(mix(acc, 99))


class Index:
    """One shard: postings by term, sorted by chunk, with list and block maxima."""

    def __init__(self, rows: list) -> None:
        self.items = [r["item_id"] for r in rows]
        self.question = [np.array(r["question"], np.int64).view(U64) for r in rows]
        self.answer = [np.array(r["answer"], np.int64).view(U64) for r in rows]
        post: dict[int, list] = {}
        essential: dict[int, list] = {}
        for c, r in enumerate(rows):
            share = np.array(r["impacts"], float)
            share /= share.sum()
            order = np.argsort(share, kind="stable")
            spare = set(order[np.cumsum(share[order]) <= REST].tolist())
            for k, (t, x) in enumerate(zip(r["terms"], share.tolist())):
                post.setdefault(t, []).append((c, x))
                if k not in spare:
                    essential.setdefault(t, []).append((c, x))
        self.lists = {}
        for t, p in post.items():
            x = [v for _, v in p]
            blocks = [max(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)]
            self.lists[t] = ([c for c, _ in p], x, blocks, max(x))
        self.vocabulary = np.sort(np.array(list(post), np.int64).view(U64))
        own = [essential.get(t, []) for t in self.vocabulary.view(np.int64).tolist()]
        self.ends = np.cumsum([0] + [len(p) for p in own])
        self.chunk = np.array([c for p in own for c, _ in p], np.int64)
        self.impact = np.array([x for p in own for _, x in p])

    def hopeful(self, place: np.ndarray, half: np.ndarray, need: float) -> np.ndarray:
        """Halves that with the next one reach ``need`` for some chunk, from the vocabulary places of
        the words met and the half each is in."""
        n = self.ends[place + 1] - self.ends[place]
        at = np.repeat(self.ends[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.repeat(half, n) * len(self.items) + self.chunk[at]
        key, back = np.unique(key, return_inverse=True)
        if not len(key):
            return key
        total = np.bincount(back, weights=self.impact[at])
        after = np.minimum(np.searchsorted(key, key + len(self.items)), len(key) - 1)
        both = total + np.where(key[after] == key + len(self.items), total[after], 0.0)
        return np.unique(key[both >= need - 1e-9] // len(self.items))

    def retrieve(self, terms: list[int], theta: float) -> list[tuple[int, float]]:
        """All chunks whose impacts for the distinct ``terms`` sum to ``theta``, by block-max WAND."""
        lists = [self.lists[t] for t in terms]
        at = [0] * len(lists)
        live = sorted(range(len(lists)), key=lambda i: lists[i][0][0])
        found = []
        while live:
            bound, pivot = 0.0, -1
            for k, i in enumerate(live):
                bound += lists[i][3]
                if bound >= theta - 1e-12:
                    pivot = k
                    break
            if pivot < 0:
                break
            chunk = lists[live[pivot]][0][at[live[pivot]]]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][0][at[live[pivot + 1]]] == chunk:
                pivot += 1
            # block maxima of the blocks that hold the pivot chunk
            bound, step = 0.0, None
            for i in live[: pivot + 1]:
                docs, _, blocks, _ = lists[i]
                b = bisect_left(docs, chunk, at[i]) // BLOCK
                if b < len(blocks):
                    bound += blocks[b]
                    end = docs[min((b + 1) * BLOCK, len(docs)) - 1] + 1
                    step = end if step is None else min(step, end)
            if bound >= theta - 1e-12:
                if lists[live[0]][0][at[live[0]]] == chunk:
                    score = 0.0
                    for i in live[: pivot + 1]:
                        score += lists[i][1][at[i]]
                    if score >= theta - 1e-12:
                        found.append((chunk, score))
                    move, target = live[: pivot + 1], chunk + 1
                else:
                    move, target = [i for i in live[:pivot] if lists[i][0][at[i]] < chunk], chunk
            else:
                target = step if step is not None else chunk + 1
                if pivot + 1 < len(live):
                    target = min(target, lists[live[pivot + 1]][0][at[live[pivot + 1]]])
                move, target = live[: pivot + 1], max(target, chunk + 1)
            for i in move:
                at[i] = bisect_left(lists[i][0], target, at[i])
            live = sorted((i for i in live if at[i] < len(lists[i][0])), key=lambda i: lists[i][0][at[i]])
        return found


def _search(index: Index, theta: float):
    """(doc_id, key, item_id, score, question, answer) of the verified passages of every document."""

    def run(batches):
        hasher = Hasher()
        known = index.vocabulary
        side = WINDOW // 2
        for batch in batches:
            out = []
            for a, b, buf, off in slices(batch.column("text")):
                _, _, row, h = hasher.tokens(buf, off)
                if not len(h):
                    continue
                ids, keys = (batch.column(c).slice(a, b - a).to_pylist() for c in ("doc_id", "key"))
                at = starts(row, b - a)
                place = np.minimum(np.searchsorted(known, h), len(known) - 1)
                hit = known[place] == h
                # halves are numbered along the batch, one number is left out after every text
                halves = -(-np.diff(at) // side)
                base = np.cumsum(halves + 1) - halves - 1
                half = base[row] + (np.arange(len(h)) - at[row]) // side
                found_halves = index.hopeful(place[hit], half[hit], theta - REST)
                text = np.searchsorted(base, found_halves, side="right") - 1
                first = np.maximum(0, np.minimum(found_halves - base[text], halves[text] - 2))
                for r, k in sorted(set(zip(text.tolist(), first.tolist()))):
                    x = int(at[r]) + k * side
                    y = min(x + WINDOW, int(at[r + 1]))
                    terms = np.unique(h[x:y][hit[x:y]]).view(np.int64).tolist()
                    found = index.retrieve(terms, theta)
                    if found:
                        near = grams(h[max(at[r], x - WINDOW) : min(at[r + 1], y + WINDOW)])
                        for chunk, score in found:
                            q, s = (np.isin(g, near).mean() if len(g) else 1.0 for g in (index.question[chunk], index.answer[chunk]))
                            if q >= MIN_QUESTION and s >= MIN_ANSWER:
                                out.append((ids[r], keys[r], index.items[chunk], score, float(q), float(s)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate([*[pa.int64()] * 3, *[pa.float64()] * 3])],
                ["doc_id", "key", "item_id", "score", "question", "answer"])

    return run


FOUND = "doc_id long, key long, item_id long, score double, question double, answer double"


def item_chunks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", question_col: str | None = None,
                answer_col: str | None = None) -> DataFrame:
    """Chunks of every item with BM25 impacts of their terms, materialized."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")) if not question_col else F.concat_ws(
        "\n", F.col(question_col).cast("string"), F.col(answer_col).cast("string"))
    cut = F.octet_length(F.lower(F.coalesce(F.col(question_col).cast("string"), F.lit("")))) if question_col else F.lit(None)
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.lower(text).alias("text"), cut.cast("long").alias("answer_at"),
                        F.monotonically_increasing_id().alias("row"))  # names the item's chunks: ids and texts can repeat
    shards = max(1, math.ceil((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / SHARD_BYTES))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)).cast("int"))
    schema = ("shard int, item_id long, chunk string, len int, terms array<long>, tfs array<long>, "
              "question array<long>, answer array<long>")
    chunks = materialize(rows.mapInArrow(_chunks, schema))
    n, mean = chunks.agg(F.count(F.lit(1)), F.avg("len")).first()
    post = chunks.select("shard", "chunk", "item_id", "len", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select(
        "shard", "chunk", "item_id", "len", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.lit(float(mean or 1))))
    lists = post.join(df, "term").groupBy("shard", "chunk", "item_id").agg(
        F.collect_list(F.struct("term", impact.alias("impact"))).alias("p"))
    lists = lists.select("shard", "chunk", "item_id", F.col("p.term").alias("terms"), F.col("p.impact").alias("impacts"))
    return materialize(lists.join(chunks.select("shard", "chunk", F.col("item_id").alias("own"), "question", "answer"),
                                  ["shard", "chunk"]).where(F.col("item_id").eqNullSafe(F.col("own"))).drop("own"))


def contaminated(docs: DataFrame, items: DataFrame, theta: float = THETA, id_col: str = "doc_id", text_col: str = "text",
                 item_id_col: str = "item_id", item_text_col: str = "text", question_col: str | None = None,
                 answer_col: str | None = None) -> DataFrame:
    """(doc_id, key, item_id, score, question, answer): the best verified passage of each pair of a
    document (key: its ``text_key``) and an item."""
    chunks = item_chunks(items, item_id_col, item_text_col, question_col, answer_col)
    texts = id_text(docs, id_col, text_col).withColumn("key", text_key()).withColumn("text", F.lower("text"))
    found = None
    for shard in sorted(r[0] for r in chunks.select("shard").distinct().collect()):
        index = Index(chunks.where(F.col("shard") == shard).orderBy("chunk").collect())  # at most SHARD_BYTES of text
        part = texts.mapInArrow(_search(index, theta), FOUND)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], FOUND)
    return found.groupBy("doc_id", "key", "item_id").agg(*[F.max(c).alias(c) for c in ("score", "question", "answer")])
