"""Classifiers by held-out accuracy, language-model scores and decontamination by brute force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from netpulse.llm import decontaminate, ppm, quality, toxicity
from netpulse.llm.common import fold, text_key

INSULTS = ["idiot", "pathetic", "moron", "worthless", "disgusting"]


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(11)
    syllables = ["the", "an", "er", "on", "re", "ti", "sh", "ing", "ed", "ou", "ha", "nd"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(900):
        ws = [word() for _ in range(rng.randint(30, 120))]
        toxic, good = i % 5 == 0, i % 7 != 0
        if toxic:
            for _ in range(max(2, len(ws) // 12)):
                ws[rng.randrange(len(ws))] = rng.choice(INSULTS)
        if not good:
            ws = [w.upper() + "!!" if i % 2 else w + "***" for w in ws]
        rows.append((i, " ".join(ws)))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def separation(scores, labels, held):
    pos = [s for i, s in scores.items() if i in held and labels[i]]
    neg = [s for i, s in scores.items() if i in held and not labels[i]]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


@pytest.mark.parametrize("fn, column, k, r, least", [
    (toxicity.toxicity_scores, "toxic", 4, 2, 0.9), (quality.quality_scores, "quality", 5, 0, 0.97)])
def test_classifier_on_held_out_rows(spark, make, odd_rows, labelled, fn, column, k, r, least):
    rows, labels = labelled
    more = [(10_000 + i if i is not None else None, t) for i, t in odd_rows]
    table = spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    got = fn(make(rows + more), table, column, folds=k, held_out=r).collect()
    assert len(got) == len(rows) + len(more) and all(0 <= x.score <= 1 for x in got)
    scores = {x.doc_id: x.score for x in got}
    truth = {i: y for i, y, _ in labels} if column == "quality" else {i: y for i, _, y in labels}
    held = {i for i in truth if zlib.crc32(str(i).encode()) % k == r}
    assert separation(scores, truth, held) >= least
    # labels of the held-out fold are never read
    other = spark.createDataFrame([(i, q if i not in held else 1 - q, t if i not in held else 1 - t) for i, q, t in labels],
                                  "doc_id long, quality int, toxic int")
    again = {x.doc_id: x.score for x in fn(make(rows + more), other, column, folds=k, held_out=r).collect()}
    if column == "quality":
        assert again == pytest.approx(scores)


def test_classifiers_without_labels(spark, make, odd_rows):
    none = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert {x.score for x in toxicity.toxicity_scores(make(odd_rows), none).collect()} == {0.0}
    assert {x.score for x in quality.quality_scores(make(odd_rows), none).collect()} == {0.5}
    assert quality.quality_scores(make([]), none).collect() == []
    assert toxicity.toxicity_scores(make([]), none).collect() == []


def test_fold_is_crc32_of_the_id_text(spark):
    got = {r.i: r.f for r in spark.createDataFrame([(i,) for i in (0, 7, 123456)], "i long").select("i", fold("i", 4).alias("f")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 for i in got}


# ------------------------------------------------------------------ language model


def ppm_brute(rows, held, order):
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    words, n, texts = Counter(), 0, 0

    def tokens(t):
        return (t or "").encode().lower().split()

    def symbols(t):
        return b"\n" * order + b" ".join(tokens(t)) + b"\n"

    for i, t in rows:
        if not held(i):
            words.update(tokens(t))
            n, texts = n + len(tokens(t)) + 1, texts + 1
            s = symbols(t)
            for j in range(order, len(s)):
                for k in range(order + 1):
                    counts[k][s[j - k : j]][s[j]] += 1
    distinct = len(words) + (texts > 0)

    def p(ctx, x):
        out, gone = 1.0, set()
        for k in range(order, -1, -1):
            c = counts[k].get(ctx[order - k :] if k else b"")
            if not c:
                continue
            total, d = sum(v for s, v in c.items() if s not in gone), sum(s not in gone for s in c)
            if x in c:
                return out * (c[x] - 0.5) / total
            if total:
                out *= d / (2 * total)
            gone = set(c)
        return out / (256 - len(gone))

    def score(t):
        s = symbols(t)
        base = [(words[w] + 1) / (n + distinct + 1) for w in tokens(t)] + [(texts + 1) / (n + distinct + 1)]
        return (sum(math.log10(p(s[j - order : j], s[j])) for j in range(order, len(s))), sum(map(math.log10, base)),
                len(base), sum(words[w] > 0 for w in tokens(t)) + (texts > 0), n)

    return score, p


def test_ppm_matches_brute_force(make, prose, odd_rows):
    rows = prose[:60] + [r for r in odd_rows if r[0] not in (7, 8)] + [(500, "zzz" * 200)]
    held = lambda i: zlib.crc32(str(i if i is not None else "").encode()) % 7 == 2
    score, _ = ppm_brute(rows, held, 3)
    got = ppm.text_scores(make(rows), fold("doc_id", 7) == 2, order=3).collect()
    want = sorted([(i, held(i), *[round(x, 6) for x in score(t)]) for i, t in rows], key=str)
    found = sorted([(r.doc_id, r.held_out, round(r.score, 6), round(r.base_score, 6), r.n_tokens, r.n_known, r.train_tokens) for r in got], key=str)
    assert found == want


def test_ppm_probabilities_sum_to_one(prose):
    _, p = ppm_brute(prose[:10], lambda i: False, 3)
    for ctx in (b"\n\n\n", b"ab ", b"zzz", b"\n\na"):
        assert sum(p(ctx, x) for x in range(256)) <= 1 + 1e-9
    assert sum(p(b"zzz", x) for x in range(256)) == pytest.approx(1.0)


def test_ppm_without_training_texts_or_rows(make):
    got = ppm.text_scores(make([(1, "ab"), (2, None)]), F.lit(True)).collect()
    assert {r.doc_id: round(r.score, 6) for r in got} == {1: round(-3 * math.log10(256), 6), 2: round(-math.log10(256), 6)}
    assert {r.n_known for r in got} == {0} and {r.train_tokens for r in got} == {0}
    assert ppm.text_scores(make([]), F.lit(False)).collect() == []


# ------------------------------------------------------------------ decontamination


def test_wand_retrieves_all_above_the_threshold():
    rng = np.random.default_rng(0)
    rows = []
    for i in range(200):
        t = np.unique(rng.zipf(1.3, 30) % 300)
        rows.append({"item_id": i, "question": [], "answer": [], "terms": t.tolist(), "impacts": rng.random(len(t)).tolist()})
    index = decontaminate.Index(rows)
    shares = [dict(zip(r["terms"], np.array(r["impacts"]) / sum(r["impacts"]))) for r in rows]
    for _ in range(100):
        terms = np.intersect1d(rng.integers(0, 300, 60), index.vocabulary.view(np.int64)).tolist()
        for theta in (0.2, 0.35, 0.6):
            want = {c for c, d in enumerate(shares) if sum(d.get(t, 0.0) for t in terms) >= theta - 1e-12}
            assert {c for c, _ in index.retrieve(terms, theta)} == want


def items_table(spark, rows):
    return spark.createDataFrame([(i, t, 1.0, 2) for i, t in rows], "item_id long, text string, score double, key long")


def test_planted_passages_are_found_and_others_left(spark, make, prose, odd_rows, monkeypatch):
    rng = random.Random(9)
    words = sorted({w for _, t in prose for w in t.split()})
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(12, 90))) + ".") for k in range(30)]
    rows, want = [], set()
    for i, t in prose:
        if i % 4 == 0:
            k = rng.randrange(30)
            cut = rng.randrange(len(t.split()) + 1)
            passage = items[k][1].upper() if i % 8 == 0 else items[k][1]
            t = " ".join([*t.split()[:cut], passage, *t.split()[cut:]])
            want.add((i, k))
        rows.append((i, t))
    rows += [(1000 + i if i is not None else None, t) for i, t in odd_rows]
    items += [(40, None), (41, ""), (42, " . "), (3, items[3][1]), (None, None)]
    got = decontaminate.contaminated(make(rows), items_table(spark, items))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    plain = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    for i, k in want:  # what was planted is there word for word
        assert " ".join(plain(items[k][1])) in " ".join(plain(dict(rows)[i]))
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 2000)  # several shards
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(make(rows), items_table(spark, items)).collect()} == want


def test_items_that_repeat_in_several_partitions(spark, make):
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(40))
    first, other = ([(i, text()) for i in [*range(6), None]] for _ in range(2))
    rows = [(k, "before it " + t + " and after") for k, (_, t) in enumerate(first + other)]
    # the same rows in the same order, then other texts under the same ids
    parts = [items_table(spark, part) for part in (first, first, other)]
    got = decontaminate.contaminated(make(rows), parts[0].unionByName(parts[1]).unionByName(parts[2])).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, i) for k, (i, _) in enumerate(first + other)}
    assert all(r.score > 0.99 for r in got)


def test_question_without_answer_is_no_leak(spark, make):
    q, a = "which river runs past the old mill near the tall oak at dawn", "the silver stream of evermore"
    items = spark.createDataFrame([(1, q, a)], "item_id long, question string, answer string")
    filler = "some words that stand around it and mean nothing at all to anyone who reads"
    docs = make([(1, f"{filler} {q} {filler}"), (2, f"{filler} {q} {a} {filler}")])
    got = decontaminate.contaminated(docs, items, question_col="question", answer_col="answer", theta=0.5).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(2, 1)]


def test_no_items_or_no_documents(spark, make, prose):
    none = items_table(spark, [])
    assert decontaminate.contaminated(make(prose[:5]), none).collect() == []
    assert decontaminate.contaminated(make([]), items_table(spark, [(1, "a b c d e f g")])).collect() == []


def test_text_key_of_null_is_that_of_the_empty_text(make):
    keys = [r[0] for r in make([(1, None), (2, "")]).select(text_key()).collect()]
    assert keys[0] == keys[1]
