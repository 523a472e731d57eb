from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from netpulse.functions.exprs import hash_order
from netpulse.operators import joins as J
from netpulse.operators import sampling as S

RAW = "run_id string, session_id string, timestamp timestamp, packets_sent long, packets_lost long, rtt_ms double, " \
      "retransmissions long, resets long"
PH = "run_id string, pos int, phase_name string, start_offset_seconds double, end_offset_seconds double, label int, " \
     "impairment_type string, severity string"


def _raw(spark, offsets, run="r1"):
    t0 = datetime(2026, 4, 6)
    return spark.createDataFrame([(run, "s", t0 + timedelta(seconds=o), 1, 0, 1.0, 0, 0) for o in offsets], RAW)


def test_phase_labels(spark):
    phases = spark.createDataFrame([("r1", 0, "baseline", 0.0, 10.0, 0, "none", "none"),
                                    ("r1", 1, "loss", 10.0, 20.0, 1, "loss", "severe")], PH)
    out = J.build_experiment_dataset(_raw(spark, [0, 5, 10, 15]), phases).orderBy("timestamp").collect()
    assert [r["label"] for r in out] == [0, 0, 1, 1]
    assert [r["phase_name"] for r in out] == ["baseline", "baseline", "loss", "loss"]


def test_overlap_last_listed_wins_and_strict(spark):
    phases = spark.createDataFrame([("r1", 0, "a", 0.0, 12.0, 0, "none", "none"),
                                    ("r1", 1, "b", 8.0, 20.0, 1, "loss", "mild")], PH)
    raw = _raw(spark, [0, 9, 25])
    lab = J.label_by_phase(raw, phases).orderBy("timestamp").collect()
    assert [r["phase_name"] for r in lab] == ["a", "b", "unlabeled"]
    assert lab[2]["severity"] == "none" and lab[2]["label"] == 0
    with pytest.raises(ValueError, match="do not cover"):
        J.build_experiment_dataset(raw, phases, strict_coverage=True)


def test_run_start_is_per_run(spark):
    phases = spark.createDataFrame([("r1", 0, "a", 0.0, 1.0, 0, "none", "none"),
                                    ("r2", 0, "b", 0.0, 1.0, 1, "loss", "mild")], PH)
    raw = _raw(spark, [0], "r1").unionByName(_raw(spark, [100], "r2"))
    assert sorted(r["phase_name"] for r in J.label_by_phase(raw, phases).collect()) == ["a", "b"]


def _features(spark, n_sessions=10, labels=None):
    labels = labels or [i % 2 for i in range(n_sessions)]
    rows = [(f"s{i}", "d0" if i < n_sessions // 2 else "d1", datetime(2026, 4, 6) + timedelta(days=w), labels[i])
            for i in range(n_sessions) for w in range(2)]
    return spark.createDataFrame(rows, "session_id string, domain string, window_start timestamp, label int")


def test_split_quota_and_determinism(spark):
    f = _features(spark, 10)
    a = S.session_split(f, 0.2, 42).where("is_validation").collect()
    b = S.session_split(f, 0.2, 42).where("is_validation").collect()
    assert sorted(r["session_id"] for r in a) == sorted(r["session_id"] for r in b)
    # ceil(0.2 * 10) = 3 (0.2 * 10 is 2.0000000000000004), stratified 1/2 with largest remainder
    assert len(a) == 2 or len(a) == 3
    assert {r["label"] for r in a} == {0, 1}
    with pytest.raises(ValueError):
        S.session_split(f, 1.0)
    assert S.session_split(f, 0.0).where("is_validation").count() == 0


def test_single_session_label_stays_in_train(spark):
    f = _features(spark, 6, labels=[0, 0, 0, 0, 0, 1])
    val = S.session_split(f, 0.5, 1).where("is_validation").collect()
    assert all(r["label"] == 0 for r in val)


def test_balance_and_downsample(spark):
    f = _features(spark, 10).unionByName(
        _features(spark, 4).withColumn("domain", F.lit("d2")).withColumn("session_id", F.concat(F.lit("x"), "session_id")))
    bal = S.balance_domains(f, 42)
    counts = {r["domain"]: r["count"] for r in bal.groupBy("domain").count().collect()}
    assert set(counts.values()) == {8}
    assert S.downsample(f, 5).count() == 5
    assert S.downsample(f, 10_000).count() == f.count()


def test_folds(spark):
    f = _features(spark, 4)
    folds = J.holdout_folds(f)
    assert folds.count() == 2 * f.count()
    assert folds.where("role = 'eval' AND holdout <> domain").count() == 0
    with pytest.raises(ValueError):
        J.holdout_folds(f.where("domain = 'd0'"))


def test_downsample_takes_the_smallest_hashes(spark):
    f = _features(spark, 40)
    h = hash_order(7, "session_id", "window_start")
    for n in (0, 13, 1000):
        got = sorted((r["session_id"], r["window_start"]) for r in S.downsample(f, n, 7).collect())
        want = sorted((r["session_id"], r["window_start"]) for r in f.orderBy(h, "session_id", "window_start").limit(n).collect())
        assert got == want