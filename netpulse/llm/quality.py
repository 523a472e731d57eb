"""Quality scores: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Words are runs of letters and digits or runs of punctuation. Features of a text are its words,
its pairs of neighbouring words and its pairs of word shapes (lower, capitalised, capitals, the
punctuation itself), hashed into ``DIM`` weights; a value is log(1 + count), scaled to unit length.

FTRL-proximal updates are sequential, so the fit runs in one task over a bounded sample
(``max_train`` rows, see ``labelled_sample``) and returns only the weights: a fixed ``DIM`` doubles,
which every scoring task receives. Scoring is a sparse dot product per whole text.

Nulls: a null text is the empty text; it has no features, and its score is the fitted prior. Without
labelled rows of both kinds every score is 0.5. Null and repeated ids are scored row by row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netpulse.llm.common import id_text, labelled_sample, text_key
from netpulse.llm.textops import U64, Hasher, mix, slices, starts

DIM = 1 << 18
MAX_TRAIN = 6000


class Features:
    """Hashed features of all texts of a batch at once."""

    def __init__(self) -> None:
        self.hasher = Hasher()
        kind = np.ones(256, np.uint8)
        kind[:128] = 2
        kind[self.hasher.space] = 0
        for a, b in ((48, 58), (65, 91), (97, 123)):
            kind[a:b] = 1
        kind[:32] = np.where(self.hasher.space[:32], 0, 2)
        self.kind = kind

    def _runs(self, buf, off):
        k = self.kind[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[off[:-1]] = edge[len(buf)] = True
        change = np.ones(len(buf) + 1, bool)
        change[1:-1] = (k[1:] != k[:-1]) | edge[1:-1]
        start = np.flatnonzero((k > 0) & change[:-1])
        end = np.flatnonzero((k > 0) & change[1:]) + 1
        return k, start, end, np.searchsorted(off, start, side="right") - 1

    def of(self, buf: np.ndarray, off: np.ndarray):
        """(feature, row) pairs, sorted by row."""
        hs = self.hasher
        k, start, end, row = self._runs(buf, off)
        word = hs._hash(buf, start, end)
        upper = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((buf >= 65) & (buf <= 90), out=upper[1:])
        n_upper, length = upper[end] - upper[start], end - start
        shape = np.where(n_upper == 0, 0, np.where((n_upper == length) & (length > 1), 2, 1))
        shape = np.where(k[start] == 2, word, mix(shape.astype(U64), 9))
        together = row[1:] == row[:-1]
        pairs = (mix(word[:-1], 1) + mix(word[1:], 2))[together]
        shapes = (mix(shape[:-1], 3) + mix(shape[1:], 4))[together]
        feature = np.concatenate([word, mix(pairs, 5), mix(shapes, 6)]) % U64(DIM)
        rows = np.concatenate([row, row[1:][together], row[1:][together]])
        order = np.argsort(rows, kind="stable")
        return feature[order].astype(np.int64), rows[order]

    def vectors(self, texts) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per text its distinct features and their values."""
        out = []
        for a, b, buf, off in slices(texts):
            feature, rows = self.of(buf, off)
            at = starts(rows, b - a)
            for r in range(b - a):
                u, n = np.unique(feature[at[r] : at[r + 1]], return_counts=True)
                v = np.log1p(n)
                out.append((u, v / np.sqrt((v * v).sum()) if len(v) else v))
        return out


def ftrl(rows: list, labels: list[int], alpha: float = 2.0, beta: float = 1.0, l2: float = 1e-3, epochs: int = 2):
    """(weights, bias) after FTRL-proximal updates over the rows in order, ``epochs`` times."""
    z, n = np.zeros(DIM), np.zeros(DIM)
    bz = bn = 0.0
    for _ in range(epochs):
        for (u, x), y in zip(rows, labels):
            zu, nu = z[u], n[u]
            w = -zu / ((beta + np.sqrt(nu)) / alpha + l2)
            b = -bz / ((beta + np.sqrt(bn)) / alpha)
            g = 1.0 / (1.0 + np.exp(-(w @ x + b))) - y
            gx = g * x
            z[u] = zu + gx - (np.sqrt(nu + gx * gx) - np.sqrt(nu)) / alpha * w
            n[u] = nu + gx * gx
            bz += g - (np.sqrt(bn + g * g) - np.sqrt(bn)) / alpha * b
            bn += g * g
    return -z / ((beta + np.sqrt(n)) / alpha + l2), -bz / ((beta + np.sqrt(bn)) / alpha)


def fit(sample: DataFrame) -> np.ndarray:
    """Weights and, last, the bias, from (label, h, text) rows."""

    def run(batches):
        labels, order, rows, features = [], [], [], Features()
        for batch in batches:
            labels += batch.column("label").to_pylist()
            order += batch.column("h").to_pylist()
            rows += features.vectors(batch.column("text"))
        if len(set(labels)) < 2:
            return
        at = np.argsort(np.array(order), kind="stable")
        w, b = ftrl([rows[i] for i in at], [labels[i] for i in at])
        yield pa.RecordBatch.from_arrays([pa.array([np.append(w, b).tobytes()], pa.binary())], ["model"])

    found = sample.coalesce(1).mapInArrow(run, "model binary").collect()
    return np.frombuffer(found[0]["model"]) if found else np.zeros(DIM + 1)


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held_out: int = 0,
                   max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, score): the probability of label 1 of every whole text; key is its ``text_key``."""
    model = fit(labelled_sample(docs, labels, label, folds, held_out, max_train, id_col, text_col))

    def run(batches):
        features = Features()
        w, b = model[:-1], model[-1]
        for batch in batches:
            margin = np.array([w[u] @ x for u, x in features.vectors(batch.column("text"))]) + b
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(1.0 / (1.0 + np.exp(-margin)))], ["doc_id", "key", "score"])

    return id_text(docs, id_col, text_col).withColumn("key", text_key()).mapInArrow(run, "doc_id long, key long, score double")
