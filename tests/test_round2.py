"""File readers, orders, streams and models on the inputs that one clean table does not show."""

import os
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from netpulse.operators import clean as C
from netpulse.operators import decisions as D
from netpulse.operators import joins as J
from netpulse.operators import metrics as M
from netpulse.operators import ml as ML
from netpulse.operators import sequences as Q
from netpulse.operators.windows import window_aggregate, window_features
from netpulse.plans.ordering import ordered_prefix
from netpulse.sources import io as IO
from netpulse.streaming import streams as ST

from .test_ml import b2_features


def write(folder, name, text):
    path = os.path.join(folder, name)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_csv_files_with_swapped_headers(spark, tmpdir_path):
    a = write(tmpdir_path, "m.csv", "fwd,bwd\n1,10\n2,20\n")
    b = write(tmpdir_path, "t.csv", "bwd,fwd,extra\n30,3,x\n")
    got = sorted((r.source, r._row, r.fwd, r.bwd, r.extra) for r in IO.read_flow_csv(spark, [a, b]).collect())
    assert got == [("m", 0, "1", "10", None), ("m", 1, "2", "20", None), ("t", 0, "3", "30", "x")]


def test_files_of_the_same_name_stay_apart(spark, tmpdir_path):
    a = write(tmpdir_path, "d1/t.txt", "1.0 x\n2.0 x\n")
    b = write(tmpdir_path, "d2/t.txt", "5.0 x\nbad\n\t6.0\tx\n")
    got = sorted((r.trace_id, r.packet_index, r.epoch) for r in IO.read_packet_dump(spark, [a, b]).collect())
    assert got == [("d1/t", 0, 1.0), ("d1/t", 1, 2.0), ("d2/t", 0, 5.0), ("d2/t", 1, 6.0)]
    c, d = (write(tmpdir_path, f"{x}/flow.csv", "v\n1\n") for x in ("e1", "e2"))
    assert sorted((r.source, r._row) for r in IO.read_flow_csv(spark, [c, d]).collect()) == [("e1/flow", 0), ("e2/flow", 0)]


@pytest.mark.parametrize("size", ["64", "1000", "128m"])
def test_row_numbers_of_a_file_read_in_many_splits(spark, tmpdir_path, size):
    path = write(tmpdir_path, "big.csv", "v\n" + "".join(f"{i}\n" for i in range(500)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        rows = IO.read_flow_csv(spark, path).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == 500 and all(int(r.v) == r._row for r in rows)


def test_arff_rows_are_all_lines_after_data(spark, tmpdir_path):
    path = write(tmpdir_path, "a.arff", "% c\n@relation r\n@attribute x string\n@ATTRIBUTE 'y z' numeric\n\n@DATA\n% note\n@home,1\n\nplain,2\n")
    got = sorted((r._row, r.x, r["y z"]) for r in IO.read_arff(spark, path).collect())
    assert got == [(0, "@home", "1"), (1, "plain", "2")]
    with pytest.raises(ValueError):
        IO.read_arff(spark, write(tmpdir_path, "b.arff", "@data\n1\n"))


def test_fractions_are_kept_and_overflow_raises(spark):
    rows = [("s", datetime(2026, 4, 6), 2.5, 0.5, 1.0, "10.0", 0, 1)]
    raw = spark.createDataFrame(rows, "session_id string, timestamp timestamp, packets_sent double, packets_lost double, rtt_ms double, "
                                      "retransmissions string, resets long, label int")
    agg = window_aggregate(C.normalize_sensor_metrics(raw)).first()
    assert (agg.packets_sent, agg.packets_lost, agg.retransmissions, agg.resets) == (2.5, 0.5, 10.0, 0)
    inf = spark.createDataFrame([(float("inf"),)], "v double")
    with pytest.raises(Exception, match="(?i)overflow|cast"):
        inf.select(C.to_long(F.col("v"))).collect()


def test_labels_and_times(spark):
    df = spark.createDataFrame([("BENIGN\t",), (" benign ",), ("Bot",), (None,)], "l string")
    assert [r[0] for r in df.select(C.label_not_benign("l")).collect()] == [0, 0, 1, 1]
    text = spark.createDataFrame([("yesterday",)], "t string")
    with pytest.raises(Exception, match="(?i)parse|timestamp"):
        text.select(C.parse_mixed_timestamps("t", text.schema["t"].dataType)).collect()


def test_canonical_names():
    assert C.canonical_names(["A b", "a-b", "a_b_2", "A  B", "!", "?", ""]) == ["a_b", "a_b_2", "a_b_2_2", "a_b_3", "column", "_2", "_3"]


def test_incomplete_phases_are_rejected(spark):
    schema = "run_id string, pos int, phase_name string, start_offset_seconds double, end_offset_seconds double, label int, impairment_type string, severity string"
    rows = [("r", 0, "ok", 0.0, 1.0, 0, "n", "none"), ("r", 1, "open", 1.0, None, None, "n", "none")]
    assert [r.phase_name for r in J.validate_phases(spark.createDataFrame(rows, schema)).collect()] == ["open"]


def test_sequences_without_an_index_over_many_partitions(spark):
    times = [datetime(2026, 4, 6) + timedelta(milliseconds=i * (i + 1) // 2) for i in range(300)]
    rows = [("a", t) for t in reversed(times)] + [(None, times[0]), (None, times[5])]
    packets = spark.createDataFrame(rows, "trace_id string, timestamp timestamp").repartition(7)
    iat = Q.inter_arrival_times(packets)
    assert iat.columns == ["trace_id", "packet_time_us", "iat_ms"] and iat.where("trace_id is null").isEmpty()
    got = sorted((r.packet_index, r.actual_iat_ms) for r in Q.iat_sequences(iat, 3).collect())
    assert [v for _, v in got] == [float(i) for i in range(4, 300)]
    with pytest.raises(ValueError):
        Q.iat_sequences(iat.drop("packet_time_us"), 3)
    with pytest.raises(ValueError):
        Q.iat_inference_frame(iat, 1.0, 1.0, 400)


def test_prefix_sums_with_null_keys(spark):
    rows = [(None, i, 1.0) for i in range(5)] + [("a", i, 2.0) for i in range(5)]
    out = ordered_prefix(spark.createDataFrame(rows, "k string, o long, v double"), ["o"], ["v"], ["k"], num_partitions=4)
    assert sorted((r.k or "", r.o, r.cum_v) for r in out.collect()) == sorted(
        [("", i, float(i)) for i in range(5)] + [("a", i, 2.0 * i) for i in range(5)])


def test_session_baseline_in_two_batches_after_idle_days(spark, tmpdir_path):
    """A session that comes back after six days keeps its first window, as in batch."""
    schema = "session_id string, timestamp timestamp, packets_sent long, packets_lost long, rtt_ms double, retransmissions long, resets long, label int"
    src, sink = os.path.join(tmpdir_path, "src"), os.path.join(tmpdir_path, "sink")
    t0 = datetime(2026, 4, 6)

    for n, (day, lost) in enumerate(((0, 0), (6, 4))):
        raw = spark.createDataFrame([("s", t0 + timedelta(days=day, seconds=i), 10, lost, 20.0, 0, 0, 0) for i in range(3)], schema)
        windows = window_features(window_aggregate(raw, 5), 5)
        windows.coalesce(1).write.parquet(os.path.join(src, str(n)))
        rows = spark.readStream.schema(windows.schema).option("recursiveFileLookup", "true").parquet(src)
        out = ST.run_available_now(ST.stream_session_baseline(rows, "1 second"), sink)  # one micro-batch a day
    got = {r.window_start: r.packet_loss_ratio_delta for r in spark.read.parquet(out).collect()}
    assert got[t0 + timedelta(days=6)] == pytest.approx(4 / 14) and got[t0] == 0.0


def test_ingest_time_does_not_depend_on_the_zone(spark, tmpdir_path):
    rows = spark.createDataFrame([("i", "t", datetime(2026, 4, 6), -1, 2)], "isp_id string, transport string, hour timestamp, success_count long, failure_count long")
    accepted, _ = D.ingest_session_aggregates(rows.select(*[F.lit(D.TRANSPORTS[0]).alias(c) if c == "transport" else (
        F.col(c) if c in rows.columns else F.lit(0).alias(c)) for c in (*D.AGGREGATE_KEYS, "success_count", "failure_count")]))
    r = accepted.select(F.unix_timestamp("created_at").alias("t"), "success_count").first()
    assert abs(r.t - datetime.now(timezone.utc).timestamp()) < 300 and r.success_count == -1


def test_reports_under_a_hot_group(spark):
    """Most rows in one group: exact figures, whatever the partitions."""
    rows = [("hot" if i % 10 else "cold", (i * 37 % 101) / 100.0, int(i * 37 % 101 + i % 7 > 60)) for i in range(2000)]
    got = {r.domain: r for r in M.metrics_by_domain(spark.createDataFrame(rows, "domain string, probability double, label int"), 0.5).collect()}
    for d in ("hot", "cold"):
        own = [(p, y) for g, p, y in rows if g == d]
        pos, neg = [p for p, y in own if y], [p for p, y in own if not y]
        auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        assert got[d].roc_auc == pytest.approx(auc)
        ps = sorted(p for p, _ in own)
        k = 0.25 * (len(ps) - 1)
        assert got[d].prob_p25 == pytest.approx(ps[int(k)] + (k - int(k)) * (ps[min(int(k) + 1, len(ps) - 1)] - ps[int(k)]))


@pytest.mark.parametrize("algorithm", ["logistic_regression", "lightgbm_sigmoid"])
def test_saved_models_score_as_before(spark, tmpdir_path, algorithm):
    feats = b2_features(spark)
    model, _ = ML.fit_sensor_model(feats, algorithm, num_trees=2)
    before = sorted((r.session_id, r.window_start, round(r.probability, 9)) for r in ML.score(model, feats).collect())
    ML.save_model(model, f"file:{tmpdir_path}/m", {"threshold": 0.4})
    loaded, meta = ML.load_model(spark, f"file:{tmpdir_path}/m")
    assert meta == {"threshold": 0.4}
    after = sorted((r.session_id, r.window_start, round(r.probability, 9)) for r in ML.infer_sensor(loaded, feats.drop("label"), metadata=meta).collect())
    assert [a[2] for a in after] == [b[2] for b in before]


def test_holdout_report_has_counts_and_times(spark):
    report = ML.evaluate_holdouts(b2_features(spark, ("a", "b", "c")), "logistic_regression")
    rows = {r.holdout: r for r in report.collect()}
    assert rows["a"].train_rows == 24 and rows["a"].eval_rows == 12 and rows["a"].fit_seconds > 0
    assert rows["__macro__"].train_rows is None
