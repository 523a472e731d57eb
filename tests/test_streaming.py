import os
import warnings
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from netpulse.operators.windows import sensor_feature_frame, window_features, window_aggregate
from netpulse.streaming import streams as ST

warnings.filterwarnings("ignore", category=FutureWarning)

RAW = "session_id string, timestamp timestamp, packets_sent long, packets_lost long, rtt_ms double, " \
      "retransmissions long, resets long, label int"


def _rows(start, n, session="s1", step=1):
    return [(session, start + timedelta(seconds=step * i), 10, i % 3, 20.0 + i, i % 2, 0, i % 2) for i in range(n)]


def test_stream_windows_equal_batch_before_watermark(spark, tmpdir_path):
    t0 = datetime(2026, 4, 6, 10, 0, 0)
    df = spark.createDataFrame(_rows(t0, 120) + _rows(t0, 60, "s2", 2), RAW)
    src = os.path.join(tmpdir_path, "src")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    out = spark.read.parquet(ST.run_available_now(ST.stream_window_features(stream, 5, "10 seconds"),
                                                  os.path.join(tmpdir_path, "sink")))
    batch = window_features(window_aggregate(df, 5), 5)
    max_ts = df.agg(F.max("timestamp")).first()[0]
    bound = max_ts - timedelta(seconds=10)
    expected = batch.where(F.col("window_start") + F.expr("INTERVAL 5 SECONDS") <= F.lit(bound))
    got = {(r["session_id"], r["window_start"]): r["packet_loss_ratio"] for r in out.collect()}
    exp = {(r["session_id"], r["window_start"]): r["packet_loss_ratio"] for r in expected.collect()}
    assert got == pytest.approx(exp) and len(got) > 0


def test_late_rows_dropped(spark, tmpdir_path):
    """Rows behind the watermark of the previous micro-batch do not reopen closed windows."""
    t0 = datetime(2026, 4, 6, 10, 0, 0)
    src = os.path.join(tmpdir_path, "src")
    sink = os.path.join(tmpdir_path, "sink")
    spark.createDataFrame(_rows(t0 + timedelta(minutes=10), 30), RAW).coalesce(1).write.parquet(os.path.join(src, "a"))

    def run():
        stream = spark.readStream.schema(RAW).option("recursiveFileLookup", "true").parquet(src)
        return ST.run_available_now(ST.stream_window_features(stream, 5, "30 seconds"), sink)

    run()
    late = spark.createDataFrame(_rows(t0, 5), RAW)  # 10 minutes behind the watermark
    late.unionByName(spark.createDataFrame(_rows(t0 + timedelta(minutes=20), 30), RAW)).coalesce(1).write.parquet(
        os.path.join(src, "b"))
    run()
    spark.createDataFrame(_rows(t0 + timedelta(minutes=30), 5), RAW).coalesce(1).write.parquet(os.path.join(src, "c"))
    out = spark.read.parquet(run())
    assert out.where(F.col("window_start") < F.lit(t0 + timedelta(minutes=5))).count() == 0
    assert out.where(F.col("window_start") >= F.lit(t0 + timedelta(minutes=10))).count() > 0


def test_stream_baseline_matches_batch(spark, tmpdir_path):
    t0 = datetime(2026, 4, 6, 10, 0, 0)
    df = spark.createDataFrame(_rows(t0, 100) + _rows(t0, 100, "s2"), RAW)
    batch = {(r["session_id"], r["window_start"]): r["packet_loss_ratio_delta"]
             for r in sensor_feature_frame(df, 5).collect()}
    wins = window_features(window_aggregate(df, 5), 5)
    src = os.path.join(tmpdir_path, "wins")
    wins.write.parquet(src)
    stream = spark.readStream.schema(wins.schema).parquet(src)
    out = spark.read.parquet(ST.run_available_now(ST.stream_session_baseline(stream, "1 minute"),
                                                  os.path.join(tmpdir_path, "sink")))
    got = {(r["session_id"], r["window_start"]): r["packet_loss_ratio_delta"] for r in out.collect()}
    assert len(got) > 0
    for k, v in got.items():
        assert v == pytest.approx(batch[k])


def test_ingest_is_idempotent_per_batch(spark, tmpdir_path):
    rows = [("isp-a", "web", 12, "quic", 3, 1), ("isp-b", "video", 8, "webrtc", 5, 0), ("isp-c", "web", 1, "tcp", 1, 0)]
    df = spark.createDataFrame(rows, "isp_id string, traffic_type string, hour_bucket int, transport string, "
                                     "success_count long, failure_count long")
    writer = ST.ingest_batch(os.path.join(tmpdir_path, "store"), os.path.join(tmpdir_path, "rej"))
    writer(df, 0)
    writer(df, 0)  # replay of the same micro-batch
    assert spark.read.parquet(os.path.join(tmpdir_path, "store")).count() == 2
    assert spark.read.parquet(os.path.join(tmpdir_path, "rej")).count() == 1


def test_ping_stream(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "ping")
    os.makedirs(src)
    with open(os.path.join(src, "p1.txt"), "w") as f:
        f.write("[1776000000.123456] 64 bytes from 1.1.1.1: icmp_seq=7 ttl=57 time=23.4 ms\nno answer yet for icmp_seq=9\n")
    out = spark.read.parquet(ST.run_available_now(ST.stream_ping_rows(spark, src), os.path.join(tmpdir_path, "sink")))
    rows = {r["icmp_seq"]: r for r in out.collect()}
    assert rows[7]["rtt_ms"] == 23.4 and rows[9]["packets_lost"] == 1 and rows[9]["timestamp"] is not None
