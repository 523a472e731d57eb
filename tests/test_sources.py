import json
import os

import pytest

from netpulse.sources import io as IO


def _write(dirpath, name, text):
    p = os.path.join(dirpath, name)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)
    return p


def test_table_suffix_rules(spark, tmpdir_path):
    df = spark.createDataFrame([(1, "a")], "x long, y string")
    IO.write_table(df, os.path.join(tmpdir_path, "t.parquet"))
    IO.write_table(df, os.path.join(tmpdir_path, "t.csv"))
    assert IO.read_table(spark, os.path.join(tmpdir_path, "t.parquet")).first()["y"] == "a"
    assert IO.read_table(spark, os.path.join(tmpdir_path, "t.csv")).first()["x"] == 1
    with pytest.raises(ValueError, match="a table is .csv or .parquet"):
        IO.read_table(spark, os.path.join(tmpdir_path, "t.json"))
    with pytest.raises(ValueError, match="a table is .csv or .parquet"):
        IO.write_table(df, os.path.join(tmpdir_path, "t.txt"))


ARFF = """% comment
@relation flows

@attribute flow_id string
@attribute total_fwd_packets numeric
@attribute total_bwd_packets numeric
@attribute flow_iat_mean numeric
@attribute flow_iat_std numeric
@attribute rst_flag_count numeric
@attribute class {VPN,NonVPN}

@data
'alpha',10,2,20000,4000,0,NonVPN
'beta',20,4,40000,8000,1,VPN
"""


def test_arff_to_sensor_rows(spark, tmpdir_path):
    from netpulse.operators.clean import convert_labelled_app_flows

    p = _write(tmpdir_path, "vpn_sample.arff", ARFF)
    raw = IO.read_arff(spark, p)
    assert set(["flow_id", "total_fwd_packets", "class", "source"]) <= set(raw.columns)
    out = convert_labelled_app_flows(raw.drop("_file", "_block", "_mono"), "source", row_col="_row")
    out = out.orderBy("session_id").collect()
    assert [r["session_id"] for r in out] == ["alpha", "beta"]
    assert [r["label"] for r in out] == [0, 1]
    assert [r["rtt_ms"] for r in out] == [20.0, 40.0]


def test_packet_dump(spark, tmpdir_path):
    p = _write(tmpdir_path, "trace-a.txt", "1.0 IP a > b\nreading from file\n1.05 IP a > b\n1.20 IP b > a\n")
    out = IO.read_packet_dump(spark, p).orderBy("packet_index").collect()
    assert [(r["trace_id"], r["packet_index"], r["epoch"]) for r in out] == [
        ("trace-a", 0, 1.0), ("trace-a", 1, 1.05), ("trace-a", 2, 1.2)]


def test_ping_lines(spark):
    lines = spark.createDataFrame([
        ("[1776000000.123456] 64 bytes from 1.1.1.1: icmp_seq=7 ttl=57 time=23.4 ms",),
        ("[1776000001.000001] no answer yet for icmp_seq=9",),
        ("PING 1.1.1.1 (1.1.1.1) 56(84) bytes of data.",),
        ("64 bytes from 1.1.1.1: icmp_seq=8 ttl=57 time=20 ms",),
    ], "value string")
    out = IO.parse_ping_log(lines).collect()
    assert len(out) == 3
    a, b, c = out
    assert (a["event_type"], a["icmp_seq"], a["packets_lost"], a["rtt_ms"]) == ("reply", 7, 0, 23.4)
    assert a["epoch"] == pytest.approx(1776000000.123456)
    assert (b["event_type"], b["icmp_seq"], b["packets_lost"], b["rtt_ms"]) == ("timeout", 9, 1, 0.0)
    assert c["epoch"] is None and c["rtt_ms"] == 20.0


def _manifest(run_id, phases):
    return {"run_id": run_id, "created_at": "2026-04-06T00:00:00Z", "domain": "lab", "application": "web",
            "scenario": "loss", "window_seconds": 5, "files": {"raw_metrics": "raw.csv"}, "phases": phases}


def test_manifests_and_validation(spark, tmpdir_path):
    ok = _manifest("r1", [
        {"name": "baseline", "start_offset_seconds": 0, "duration_seconds": 10, "label": 0, "impairment_type": "none"},
        {"name": "loss", "start_offset_seconds": 10, "duration_seconds": 10, "label": 1, "impairment_type": "loss",
         "severity": "severe"}])
    p = _write(tmpdir_path, "m1.json", json.dumps(ok, indent=2))
    runs, phases = IO.read_manifests(spark, p)
    rows = phases.orderBy("pos").collect()
    assert [(r["pos"], r["phase_name"], r["end_offset_seconds"], r["severity"]) for r in rows] == [
        (0, "baseline", 10.0, "none"), (1, "loss", 20.0, "severe")]
    assert runs.first()["domain"] == "lab"
    bad = _manifest("r2", [{"name": "x", "start_offset_seconds": 0, "duration_seconds": 0, "label": 0,
                            "impairment_type": "none"}])
    p2 = _write(tmpdir_path, "m2.json", json.dumps(bad))
    with pytest.raises(ValueError, match="break the manifest rules"):
        IO.read_manifests(spark, p2)


def test_report_json_sorted_keys(spark, tmpdir_path):
    df = spark.createDataFrame([(0.5, "d0", 3)], "f1 double, domain string, rows long")
    IO.write_report(df, os.path.join(tmpdir_path, "report"))
    text = spark.read.text(os.path.join(tmpdir_path, "report")).first()["value"]
    assert list(json.loads(text).keys()) == ["domain", "f1", "rows"]


def test_load_domains(spark, tmpdir_path):
    from datetime import datetime

    cols = "session_id string, timestamp timestamp, packets_sent long, packets_lost long, rtt_ms double, " \
           "retransmissions long, resets long, label int"
    a = spark.createDataFrame([("s1", datetime(2026, 4, 6), 10, 0, 1.0, 0, 0, 0)], cols)
    IO.write_table(a, os.path.join(tmpdir_path, "alpha.parquet"))
    IO.write_table(a, os.path.join(tmpdir_path, "beta.parquet"))
    out = IO.load_domains(spark, [os.path.join(tmpdir_path, "alpha.parquet"), os.path.join(tmpdir_path, "beta.parquet")])
    assert sorted(r["session_id"] for r in out.collect()) == ["alpha::s1", "beta::s1"]
    with pytest.raises(ValueError):
        IO.load_domains(spark, [os.path.join(tmpdir_path, "alpha.parquet")], domain_names=["a", "b"])


def test_packet_dump_split_file_keeps_line_order(spark, tmpdir_path):
    """A dump split into many scan partitions still numbers valid lines in file order."""
    lines = []
    for i in range(3000):
        lines.append(f"{1000 + i * 0.01:.2f} IP a > b length {i}")
        if i % 7 == 0:
            lines.append("reading from file dump.pcap, link-type EN10MB")
    p = _write(tmpdir_path, "big-trace.txt", "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        out = IO.read_packet_dump(spark, p)
        assert out.rdd.getNumPartitions() >= 1
        rows = sorted((r["packet_index"], r["epoch"]) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [i for i, _ in rows] == list(range(3000))
    assert all(abs(e - (1000 + i * 0.01)) < 1e-9 for i, e in rows)


def test_arff_header_of_any_length(spark, tmpdir_path):
    path = f"{tmpdir_path}/long.arff"
    with open(path, "w") as f:
        f.write("@relation r\n@attribute a numeric\n" + "% note\n" * 100_001 + "@attribute b numeric\n@data\n1,2\n3,4\n")
    rows = IO.read_arff(spark, path).orderBy("_row").collect()
    assert [(r.a, r.b, r["_row"]) for r in rows] == [("1", "2", 0), ("3", "4", 1)]
