"""Toxicity by compression distance: windows compress shorter with a dictionary of toxic text.

Fit (one task, at most ``max_train`` labelled documents; see ``labelled_sample``):
* Copies would let their own words pass for toxic ones, so a document that shares two of three
  minimum word hashes with an earlier one of its label is left out of the dictionaries.
* Ordinary text: the label-0 documents. Toxic text: the words of label-1 documents that hold a
  telling gram, one of ``GRAM`` bytes that ``MIN_SHARE`` of them have, ``LIFT`` times as many as of
  the ordinary documents; the other words of a toxic document are ordinary text.
* The toxic compressor holds both dictionaries, the ordinary one only the first, so a window's two
  lengths differ by what its toxic text saves.
* The curve is fitted across halves: each half is measured under dictionaries of the other.

A text's windows of ``WINDOW`` words give their length differences; mean, extremes and the
shares and numbers above fixed differences go to a logistic curve, with its odds set to the share of label 1 in all labelled rows of the training folds.

Nulls: a null text is the empty text, one window without a difference. Without labelled rows of both
kinds no text is held toxic (score 0). Null and repeated ids are scored row by row.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netpulse.llm.common import fold, id_text, labelled_sample, text_key

MAX_TRAIN = 6000
WINDOW = 8  # words
ORDINARY_BYTES, TOXIC_BYTES = 2048, 2048
MIN_SHARE, LIFT, GRAM = 0.02, 8.0, 5
_MARKS = b".,;:!?*%&$#\"'()"


def words(text: str) -> list[bytes]:
    return text.encode().lower().split()


def windows(text: str) -> list[bytes]:
    w = words(text)
    return [b" " + b" ".join(w[i : i + WINDOW]) + b" " for i in range(0, len(w), WINDOW)] or [b""]


def without_copies(texts: list[list[bytes]]) -> list[list[bytes]]:
    """Word lists, without those that share two of three minimum word hashes with an earlier one."""
    seen: set = set()
    kept = []
    for ws in texts:
        if not ws:
            continue
        h = np.array([zlib.crc32(w) for w in set(ws)], np.uint64)
        marks = [(k, int(((h * np.uint64(m)) & np.uint64(0xFFFFFFFF)).min())) for k, m in enumerate((2654435761, 2246822519, 3266489917))]
        if sum(m in seen for m in marks) < 2:
            seen.update(marks)
            kept.append(ws)
    return kept


def dictionary(samples: list[bytes], size: int, segment: int, gram: int) -> bytes:
    """A trained zstandard dictionary's bytes; with too few samples to train, the samples themselves."""
    import zstandard as z

    try:
        return z.train_dictionary(size, samples, k=segment, d=gram, level=3).as_bytes()
    except z.ZstdError:
        return b"".join(samples)[-size:]


class Distance:
    """Window length differences under the two dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        import zstandard as z

        par = z.ZstdCompressionParameters(
            window_log=15, chain_log=12, hash_log=12, search_log=5, min_match=4, target_length=16, strategy=z.STRATEGY_LAZY,
            write_content_size=False, write_checksum=False, write_dict_id=False)

        def compressor(content: bytes):
            if len(content) < 8:
                return z.ZstdCompressor(compression_params=par)
            return z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=par)

        self.plain, self.both = compressor(ordinary).compress, compressor(toxic + ordinary).compress

    def features(self, text: str) -> list[float]:
        plain, both = self.plain, self.both
        a = np.array([len(plain(w)) - len(both(w)) for w in windows(text)], float)
        top = np.sort(a)[::-1]
        out = [a.mean(), min(top[0], 12.0), top[:3].mean(), np.log(len(a))]
        for cut in (3, 4, 5, 6):
            out.append((a >= cut).mean())
        for cut in (4, 5, 6):
            out.append(np.log1p((a >= cut).sum()))
        return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50):
    """(means, scales, weights with the constant last) of a ridge logistic fit by Newton steps."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    x = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
    return mean, scale, w


def grams(word: bytes) -> set[bytes]:
    w = b" " + word + b" "
    return {w[i : i + GRAM] for i in range(len(w) - GRAM + 1)}


def dictionaries(plain_texts: list[str], toxic_texts: list[str]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionaries from texts of label 0 and 1."""
    plain, toxic = (without_copies([[w.strip(_MARKS) for w in words(t)] for t in texts]) for texts in (plain_texts, toxic_texts))
    known: dict[bytes, set[bytes]] = {}

    def number_of_texts(texts: list[list[bytes]]) -> Counter:
        found: Counter = Counter()
        for ws in texts:
            own: set[bytes] = set()
            for w in set(ws):
                own |= known.setdefault(w, grams(w)) if len(known) < 500_000 else grams(w)
            found.update(own)
        return found

    in_toxic, in_plain = number_of_texts(toxic), number_of_texts(plain)
    n1, n0 = max(1, len(toxic)), max(1, len(plain))
    telling = {g for g, c in in_toxic.items() if c >= max(3, MIN_SHARE * n1) and c / n1 >= LIFT * (in_plain[g] + 1) / n0}
    runs = [[w for w in ws if not telling.isdisjoint(grams(w))] for ws in toxic]
    samples = [b" " + b" ".join(r[i : i + 8]) + b" " for r in runs for i in range(0, len(r), 8)]
    ordinary = [b" ".join(ws[i : i + 40]) for ws in plain for i in range(0, len(ws), 40)]
    return dictionary(ordinary, ORDINARY_BYTES, 64, 8), dictionary(samples, TOXIC_BYTES, 24, 6)


def train(texts: list[str], labels: list[int], odds: float) -> dict | None:
    """Dictionaries from all texts; the curve from differences that each half of the texts has under
    dictionaries of the other half."""
    by = {k: [t for t, y in zip(texts, labels) if y == k] for k in (0, 1)}
    if min(len(by[0]), len(by[1])) < 4:
        return None
    x, y = [], []
    for own, other in ((0, 1), (1, 0)):
        distance = Distance(*dictionaries(by[0][other::2], by[1][other::2]))
        for k in (0, 1):
            x += [distance.features(t) for t in by[k][own::2]]
            y += [k] * len(by[k][own::2])
    mean, scale, w = logistic(np.array(x), np.array(y, float))
    w[-1] += np.log(odds * len(by[0]) / len(by[1]))  # the sample takes both labels evenly
    d0, d1 = dictionaries(by[0], by[1])
    return {"ordinary": d0.hex(), "toxic": d1.hex(), "mean": mean.tolist(), "scale": scale.tolist(), "w": w.tolist()}


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, held_out: int = 2,
                    max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, score): the probability of label 1 of every whole text; key is its ``text_key``."""
    sample = labelled_sample(docs, labels, label, folds, held_out, max_train, id_col, text_col)
    share = labels.where((fold(id_col, folds) != held_out) & F.col(label).isNotNull()).agg(F.avg(F.col(label).cast("double"))).first()[0]
    odds = share / (1 - share) if share and share < 1 else 1.0

    def fit(batches):
        rows = []
        for batch in batches:
            rows += zip(batch.column("h").to_pylist(), batch.column("text").to_pylist(), batch.column("label").to_pylist())
        rows.sort()
        model = train([t for _, t, _ in rows], [y for _, _, y in rows], odds)
        if model:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(model)])], ["model"])

    found = sample.coalesce(1).mapInArrow(fit, "model string").collect()  # a few kB
    model = json.loads(found[0]["model"]) if found else None

    def score(batches):
        if model:
            distance = Distance(bytes.fromhex(model["ordinary"]), bytes.fromhex(model["toxic"]))
            mean, scale, w = (np.array(model[k]) for k in ("mean", "scale", "w"))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            p = np.zeros(len(texts))
            if model and texts:
                x = (np.array([distance.features(t) for t in texts]) - mean) / scale
                p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(p)], ["doc_id", "key", "score"])

    return id_text(docs, id_col, text_col).withColumn("key", text_key()).mapInArrow(score, "doc_id long, key long, score double")
