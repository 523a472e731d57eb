from datetime import datetime

import pytest

from netpulse.operators import decisions as D
from netpulse.operators.ml import rule_score


def test_rule_score(spark):
    df = spark.createDataFrame([(0.05, 0.10, 0.10, 0.0), (0.8, 0.9, 0.7, 0.6)],
                               "packet_loss_ratio double, rtt_cv double, retransmission_ratio double, reset_ratio double")
    out = rule_score(df).collect()
    assert out[0]["degraded"] is False
    assert out[1]["probability"] == pytest.approx(0.75) and out[1]["degraded"] is True


def test_bandit_replay(spark):
    log = spark.createDataFrame([("isp-a", 1, "doh", 1), ("isp-a", 2, "quic", -1), ("isp-b", 1, "quic", 1)],
                                "isp_id string, event_id long, transport string, reward int")
    out = {(r["isp_id"], r["event_id"]): r for r in D.choose_transport(log).collect()}
    assert out[("isp-a", 1)]["chosen_transport"] == "quic"  # no rewards yet
    assert out[("isp-a", 2)]["chosen_transport"] == "doh"  # doh got +1 -> 1.2
    assert out[("isp-b", 1)]["chosen_score"] == pytest.approx(0.6)


def test_ingest_and_recent(spark):
    df = spark.createDataFrame([("isp-a", "web", 12, "quic", 3, 1), ("isp-b", "video", 8, "webrtc", 5, 0),
                                ("isp-c", "web", 1, "tcp", 1, 0)],
                               "isp_id string, traffic_type string, hour_bucket int, transport string, "
                               "success_count long, failure_count long")
    acc, rej = D.ingest_session_aggregates(df, created_at=datetime(2026, 1, 1))
    assert acc.count() == 2 and rej.count() == 1
    stored = acc.withColumn("id", __import__("pyspark.sql.functions", fromlist=["x"]).monotonically_increasing_id())
    assert D.recent_aggregates(stored, 500).count() == 2  # clamped to 200, 2 rows exist
    assert D.recent_aggregates(stored, 0).count() == 1  # clamped to 1


def test_hour_features(spark):
    df = spark.createDataFrame([(datetime(2026, 4, 6, 6, 0),)], "ts timestamp")
    r = D.hour_features(df).first()
    assert r["hour_sin"] == pytest.approx(1.0) and r["hour_cos"] == pytest.approx(0.0, abs=1e-12)
    assert r["hour_bucket"] == 6
