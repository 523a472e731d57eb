from datetime import datetime

import pytest
from pyspark.sql import functions as F

from netpulse.operators.windows import FEATURE_COLUMNS, sensor_feature_frame

B1_COLS = ["session_id", "timestamp", "packets_sent", "packets_lost", "rtt_ms", "retransmissions", "resets", "label",
           "flow_duration_ms", "flow_packets_per_second", "flow_bytes_per_second", "average_packet_size",
           "packet_length_mean", "packet_length_std", "fwd_packet_count", "bwd_packet_count", "fwd_byte_count",
           "bwd_byte_count", "down_up_ratio", "flow_iat_mean_us", "flow_iat_std_us", "active_mean_us", "idle_mean_us",
           "syn_flag_count", "ack_flag_count", "psh_flag_count"]


def b1(spark):
    rows = [
        ("s1", datetime(2026, 4, 6, 10, 0, 0), 10, 2, 100.0, 1, 0, 0, 10.0, 4.0, 512.0, 64.0, 60.0, 12.0, 10.0, 2.0,
         500.0, 100.0, 0.2, 50000.0, 10000.0, 4000.0, 2000.0, 1.0, 10.0, 0.0),
        ("s1", datetime(2026, 4, 6, 10, 0, 4), 5, 1, 200.0, 1, 1, 1, 20.0, 6.0, 768.0, 96.0, 90.0, 18.0, 5.0, 1.0,
         400.0, 50.0, 0.5, 100000.0, 30000.0, 3000.0, 1000.0, 2.0, 5.0, 1.0),
    ]
    return spark.createDataFrame(rows, B1_COLS)


def test_one_window_exact_values(spark):
    out = sensor_feature_frame(b1(spark), 5).collect()
    assert len(out) == 1
    r = out[0].asDict()
    exp = {
        "packet_loss_ratio": 3 / 18, "packets_per_second": 18 / 5, "rtt_mean_ms": 150.0,
        "retransmission_ratio": 2 / 18, "reset_ratio": 0.5, "flow_duration_ms": 15.0, "flow_packets_per_second": 5.0,
        "packet_length_cv": 15 / 75, "fwd_backward_packet_ratio": 5.0, "flow_iat_cv": 20000 / 75000,
        "active_idle_ratio": 3500 / 1500, "syn_flag_ratio": 3 / 18, "sample_count": 2.0,
        "packet_loss_ratio_delta": 0.0, "retransmission_ratio_delta": 0.0, "flow_iat_cv_delta": 0.0,
        "rtt_mean_ratio_to_session_start": 1.0, "packets_per_second_ratio_to_session_start": 1.0,
        "flow_bytes_per_second_ratio_to_session_start": 1.0, "active_idle_ratio_to_session_start": 1.0,
    }
    for k, v in exp.items():
        assert r[k] == pytest.approx(v), k
    assert r["label"] == 1
    assert list(out[0].asDict().keys()) == ["session_id", "window_start", *FEATURE_COLUMNS, "label"]


def test_missing_columns_raise(spark):
    with pytest.raises(ValueError, match="sensor rows lack the columns"):
        sensor_feature_frame(b1(spark).drop("rtt_ms"), 5)


def test_multi_window_baseline_and_nulls(spark):
    rows = [
        ("s1", datetime(2026, 4, 6, 10, 0, 0), 10, 0, None, 0, 0, 0),
        ("s1", datetime(2026, 4, 6, 10, 0, 5), 10, 0, 50.0, 0, 0, 0),
        ("s1", datetime(2026, 4, 6, 10, 0, 10), 10, 5, 100.0, 0, 0, 1),
        (None, datetime(2026, 4, 6, 10, 0, 10), 10, 5, 100.0, 0, 0, 1),
    ]
    df = spark.createDataFrame(rows, B1_COLS[:8])
    out = {r["window_start"].second: r for r in sensor_feature_frame(df, 5).collect()}
    assert len(out) == 3  # null session dropped
    assert out[0]["rtt_mean_ms"] is None  # all-null RTT keeps NULL
    # first non-null RTT of the session (window 2) is the baseline
    assert out[10]["rtt_mean_ratio_to_session_start"] == pytest.approx(2.0)
    assert out[10]["packet_loss_ratio_delta"] == pytest.approx(5 / 15)
    assert out[5]["rtt_cv"] == 0.0  # one-row std -> 0


def test_optional_columns_missing_default_zero(spark):
    df = b1(spark).select(*B1_COLS[:8])
    r = sensor_feature_frame(df, 5).first()
    assert r["flow_duration_ms"] == 0.0 and r["fwd_backward_packet_ratio"] == 0.0


def test_window_floor_epoch_aligned(spark):
    df = b1(spark).withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 3 SECONDS"))
    starts = sorted(r["window_start"].second for r in sensor_feature_frame(df, 5).collect())
    assert starts == [0, 5]
