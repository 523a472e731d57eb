from datetime import datetime, timedelta

import pytest

from netpulse.operators import sequences as Q


def test_iat_from_times(spark):
    t0 = datetime(2026, 4, 6)
    rows = [("a", t0), ("a", t0 + timedelta(milliseconds=50)), ("a", t0 + timedelta(milliseconds=150)),
            ("b", t0), ("b", t0 + timedelta(milliseconds=30))]
    df = spark.createDataFrame(rows, "trace_id string, timestamp timestamp")
    out = sorted((r["trace_id"], r["iat_ms"]) for r in Q.inter_arrival_times(df).collect())
    assert out == [("a", 50.0), ("a", 100.0), ("b", 30.0)]


def test_iat_with_index_and_filter(spark):
    df = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 0.0), ("a", 2, 10.0)], "trace_id string, packet_index long, timestamp double")
    assert Q.inter_arrival_times(df, max_iat_ms=1000.0).count() == 0


def test_dump_iat(spark):
    df = spark.createDataFrame([("t", 0, 1.0), ("t", 1, 1.05), ("t", 2, 1.20)], "trace_id string, packet_index long, epoch double")
    out = sorted((r["packet_index"], r["iat_ms"]) for r in Q.dump_inter_arrival_times(df).collect())
    assert out == [(1, 50.0), (2, 150.0)]
    df2 = spark.createDataFrame([("t", 0, 1.0), ("t", 1, 10.0)], "trace_id string, packet_index long, epoch double")
    assert Q.dump_inter_arrival_times(df2, max_iat_ms=500.0).count() == 0


def test_sequences_shape_and_stats(spark):
    rows = [("a", i, 10.0 * (i + 1)) for i in range(5)] + [("b", i, 15.0 + 10.0 * i) for i in range(5)]
    df = spark.createDataFrame(rows, "trace_id string, packet_index long, iat_ms double")
    seq = Q.iat_sequences(df, 3).collect()
    assert len(seq) == 4 and all(len(r["inputs"]) == 3 for r in seq)
    vals = [v for _, _, v in rows]
    mean = sum(vals) / len(vals)
    std = (sum((v - mean) ** 2 for v in vals) / len(vals)) ** 0.5
    a3 = [r for r in seq if r["trace_id"] == "a" and r["packet_index"] == 3][0]
    assert a3["inputs"] == pytest.approx([(v - mean) / std for v in (10.0, 20.0, 30.0)])
    assert a3["target"] == pytest.approx((40.0 - mean) / std)
    short = spark.createDataFrame([("a", i, 1.0) for i in range(3)], "trace_id string, packet_index long, iat_ms double")
    with pytest.raises(ValueError):
        Q.iat_sequences(short, 3, require_samples=True)


def test_history_across_many_partitions(spark):
    """One hot trace spread over 8 range partitions: histories must be exact across boundaries."""
    from netpulse.plans.ordering import ordered_history

    n = 2000
    df = spark.createDataFrame([("hot", i, float(i)) for i in range(n)] + [("cold", i, -float(i)) for i in range(7)],
                               "trace_id string, packet_index long, v double")
    out = ordered_history(df, ["packet_index"], "v", 4, keys=["trace_id"], num_partitions=8).collect()
    assert len(out) == n + 7
    for r in out:
        i = r["packet_index"]
        sign = 1.0 if r["trace_id"] == "hot" else -1.0
        assert r["history"] == [sign * j for j in range(max(0, i - 4), i)]


def test_tail_split(spark):
    rows = [("trace-a", i, [0.0], 0.0) for i in range(25)] + [("trace-b", i, [0.0], 0.0) for i in range(25)]
    df = spark.createDataFrame(rows, "trace_id string, packet_index long, inputs array<double>, target double")
    out = Q.tail_split(df, 0.2)
    val = out.where("split = 'validation'").collect()
    assert len(val) == 10 and all(r["trace_id"] == "trace-b" and r["packet_index"] >= 15 for r in val)
    assert Q.tail_split(df, 0.0).where("split = 'validation'").count() == 0
    with pytest.raises(ValueError):
        Q.tail_split(df, 1.0)


def test_history_across_tiny_arrow_batches(spark):
    """Carry-over between Arrow batches inside one task (batches of 7 rows)."""
    from netpulse.plans.ordering import ordered_history

    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(t, i, float(i) + (1000.0 if t == "b" else 0.0)) for t in ("a", "b", "c") for i in range(40)]
        df = spark.createDataFrame(rows, "trace_id string, packet_index long, v double")
        out = ordered_history(df, ["packet_index"], "v", 5, keys=["trace_id"], num_partitions=3).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(out) == 120
    for r in out:
        off = 1000.0 if r["trace_id"] == "b" else 0.0
        i = r["packet_index"]
        assert r["history"] == [off + j for j in range(max(0, i - 5), i)]


def test_history_longer_than_partitions(spark):
    """L = 40 over partitions of about 25 rows: histories cross several whole partitions."""
    from netpulse.plans.ordering import ordered_history

    df = spark.createDataFrame([("t", i, float(i)) for i in range(200)], "trace_id string, packet_index long, v double")
    out = ordered_history(df, ["packet_index"], "v", 40, keys=["trace_id"], num_partitions=8).collect()
    assert len(out) == 200
    for r in out:
        i = r["packet_index"]
        assert r["history"] == [float(j) for j in range(max(0, i - 40), i)]
