import itertools
import random

import pytest

from netpulse.operators import metrics as M


def brute_auc(labels, probs):
    pos = [p for y, p in zip(labels, probs) if y == 1]
    neg = [p for y, p in zip(labels, probs) if y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in itertools.product(pos, neg))
    return s / (len(pos) * len(neg))


def brute_ap(labels, probs):
    P = sum(labels)
    total, prev_r = 0.0, 0.0
    for t in sorted(set(probs), reverse=True):
        tp = sum(1 for y, p in zip(labels, probs) if p >= t and y == 1)
        fp = sum(1 for y, p in zip(labels, probs) if p >= t and y == 0)
        r = tp / P
        total += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    return total


def test_auc_ap_with_ties_vs_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b"]), rng.randint(0, 1), rng.choice([0.1, 0.2, 0.2, 0.5, 0.7, 0.9])) for _ in range(300)]
    df = spark.createDataFrame(rows, "domain string, label int, probability double")
    got = {r["domain"]: r for r in M.ranking_metrics(df, ["domain"]).collect()}
    for d in ("a", "b"):
        ys = [y for dd, y, _ in rows if dd == d]
        ps = [p for dd, _, p in rows if dd == d]
        assert got[d]["roc_auc"] == pytest.approx(brute_auc(ys, ps))
        assert got[d]["average_precision"] == pytest.approx(brute_ap(ys, ps))


def test_one_class_gives_null(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.6)], "label int, probability double")
    r = M.ranking_metrics(df).first()
    assert r["roc_auc"] is None and r["average_precision"] is None


def test_binary_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "label int, probability double")
    r = M.binary_metrics(df, 0.5).first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"], r["tn"]) == (0.0, 0.0, 0.0, 1.0, 2)


def test_sweep_and_best(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "label int, probability double")
    sweep = M.threshold_sweep(df).orderBy("threshold").collect()
    assert len(sweep) == 19 and sweep[2]["threshold"] == 0.05 + 2 * 0.05
    for r in sweep:
        t = r["threshold"]
        assert r["tp"] == sum(1 for y, p in [(0, .1), (0, .4), (1, .35), (1, .8)] if y == 1 and p >= t)
    best = M.best_threshold(M.threshold_sweep(df)).first()
    assert best["f1"] == 1.0 or best["f1"] == max(r["f1"] for r in sweep)
    assert best["threshold"] == min(r["threshold"] for r in sweep if r["f1"] == best["f1"] and r["recall"] == best["recall"]
                                    and r["precision"] == best["precision"])


def test_probability_summary_matches_numpy(spark):
    import numpy as np

    vals = [0.1, 0.4, 0.35, 0.8, 0.8, 0.05, 0.6]
    df = spark.createDataFrame([(0, v) for v in vals], "label int, probability double")
    r = M.probability_summary(df).first()
    for name, q in (("p25", 25), ("p50", 50), ("p75", 75), ("p95", 95)):
        assert r[name] == pytest.approx(float(np.percentile(vals, q)))
    empty = M.probability_summary(df.where("label = 9")).first()
    assert all(empty[c] == 0.0 for c in ("min", "p25", "p95", "max"))


def test_regression_and_huber(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 0.0)], "y double, p double")
    r = M.regression_metrics(df, "y", "p").first()
    assert r["mae"] == pytest.approx(1.25) and r["rmse"] == pytest.approx(((0.25 + 4) / 2) ** 0.5)
    h = M.huber_loss(df, "y", "p").first()["huber_loss"]
    assert h == pytest.approx((0.5 * 0.25 + 1.5) / 2)


def test_ordered_prefix_keys_across_batches_and_partitions(spark):
    from netpulse.plans.ordering import ordered_prefix, row_index

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        rows = [("hot", i, 1) for i in range(200)] + [("cold", i, 2) for i in range(9)]
        df = spark.createDataFrame(rows, "k string, o long, v long")
        got = {(r["k"], r["o"]): r["cum_v"] for r in ordered_prefix(df, ["o"], ["v"], ["k"], num_partitions=6).collect()}
        idx = {(r["k"], r["o"]): r["row_index"] for r in row_index(df, ["o"], ["k"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for (k, o), c in got.items():
        assert c == (o if k == "hot" else 2 * o)
        assert idx[(k, o)] == o
