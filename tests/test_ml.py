from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from netpulse.operators import ml as ML
from netpulse.operators.windows import sensor_feature_frame

RAW = "session_id string, timestamp timestamp, packets_sent long, packets_lost long, rtt_ms double, " \
      "retransmissions long, resets long, label int, domain string"
B2 = {"s1": (0, 0, 30.0, 0, 0), "s2": (0, 1, 35.0, 0, 0), "s3": (1, 8, 180.0, 3, 1), "s4": (1, 7, 160.0, 2, 1)}


def b2_features(spark, domains=("lab",)):
    rows = []
    for d in domains:
        for s, (label, lost, rtt, retr, rst) in B2.items():
            for sec in range(5):
                for rep in range(3):  # three windows per session
                    t = datetime(2026, 4, 6) + timedelta(seconds=sec + 5 * rep)
                    rows.append((f"{d}-{s}", t, 10, lost, rtt + sec, retr, rst, label, d))
    return sensor_feature_frame(spark.createDataFrame(rows, RAW), 5, extra_keys=("domain",))


def test_registry_rejects_unknown():
    with pytest.raises(ValueError):
        ML.build_estimator("extra_trees")
    with pytest.raises(ValueError):
        ML.build_estimator("nope")


def test_train_and_infer(spark):
    feats = b2_features(spark)
    model, report, meta = ML.train_sensor(feats, "logistic_regression", validation_ratio=0.5)
    r = report.first()
    assert r["rows"] > 0 and r["best_f1"] >= r["f1"]
    pred = {x["session_id"]: x for x in ML.infer_sensor(model, feats.drop("label"), metadata=meta).collect()}
    assert pred["lab-s3"]["probability"] > pred["lab-s1"]["probability"]
    assert meta["threshold"] == ML.MODEL_THRESHOLD


def test_requires_two_classes(spark):
    feats = b2_features(spark).where(F.col("label") == 1)
    with pytest.raises(ValueError, match="both classes"):
        ML.train_sensor(feats, "logistic_regression")


def test_holdouts_and_compare(spark):
    feats = b2_features(spark, ("a", "b"))
    rep = {r["holdout"]: r for r in ML.evaluate_holdouts(feats, "logistic_regression").collect()}
    assert set(rep) == {"a", "b", "__macro__"}
    ranked = ML.compare_models(feats, ("logistic_regression", "random_forest"), validation_ratio=0.5, num_trees=5)
    assert sorted(r["rank"] for r in ranked.collect()) == [1, 2]


def test_calibrated_probabilities_in_range(spark):
    feats = b2_features(spark)
    model, _ = ML.fit_sensor_model(feats, "lightgbm_sigmoid", num_trees=3)
    probs = [r["probability"] for r in ML.score(model, feats).collect()]
    assert all(0.0 <= p <= 1.0 for p in probs)


def test_forecaster(spark):
    rows = [(t, i, 20.0 + off + 0.5 * i) for t, off in (("trace-a", 0.0), ("trace-b", 5.0)) for i in range(30)]
    iat = spark.createDataFrame(rows, "trace_id string, packet_index long, iat_ms double")
    model, report, meta = ML.train_iat_forecaster(iat, 5, validation_ratio=0.2, max_iter=50)
    r = report.first()
    assert r["mae"] >= 0 and r["rmse"] >= r["mae"] and meta["sequence_length"] == 5
    pred = ML.infer_iat_forecaster(model, iat, meta)
    assert pred.count() == 50
    assert pred.where(F.col("abs_error_ms") < 0).count() == 0
