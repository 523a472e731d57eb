"""Bridge views: give the driver's ``events`` table the shapes the operators consume.

Every registered query reads the given tables through these projections, so
its work grows with the data. Each view is a pure projection of ``events``
(column pruning and filter pushdown reach the parquet scan).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def _s(c: Column) -> Column:
    return c.cast("string")


def _flag(event_type: str) -> Column:
    return F.when(F.col("event_type") == event_type, F.lit(1)).otherwise(F.lit(0))


def sensor_raw(events: DataFrame) -> DataFrame:
    """Raw sensor rows (one per event) with all 18 optional flow columns and a domain."""
    e = events.select("user_id", "ts", "event_type", "value", _k().alias("k"))
    k, kd, v = F.col("k"), F.col("k").cast("double"), F.col("value")
    return e.select(
        F.concat(F.lit("u"), _s(F.col("user_id"))).alias("session_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        (F.floor(v).cast("bigint") + F.lit(1)).alias("packets_sent"),
        (k % 10).alias("packets_lost"),
        (v + F.lit(1.0)).alias("rtt_ms"),
        (k % 4).alias("retransmissions"),
        _flag("error").alias("resets"),
        _flag("error").alias("label"),
        (v * 10.0).alias("flow_duration_ms"),
        (v / 2.0).alias("flow_packets_per_second"),
        (v * 50.0).alias("flow_bytes_per_second"),
        (F.lit(40.0) + kd).alias("average_packet_size"),
        (F.lit(50.0) + kd).alias("packet_length_mean"),
        (F.lit(5.0) + (k % 7).cast("double")).alias("packet_length_std"),
        (k % 9).cast("double").alias("fwd_packet_count"),
        (k % 5).cast("double").alias("bwd_packet_count"),
        (k * 100).cast("double").alias("fwd_byte_count"),
        (k * 60).cast("double").alias("bwd_byte_count"),
        ((k % 5).cast("double") / 4.0).alias("down_up_ratio"),
        (v * 1000.0).alias("flow_iat_mean_us"),
        (v * 100.0).alias("flow_iat_std_us"),
        (v * 20.0).alias("active_mean_us"),
        (v * 8.0 + 1.0).alias("idle_mean_us"),
        (k % 2).cast("double").alias("syn_flag_count"),
        (k % 11).cast("double").alias("ack_flag_count"),
        (k % 3).cast("double").alias("psh_flag_count"),
        F.concat(F.lit("d"), _s(F.col("user_id") % 3)).alias("domain"),
    )


def packets(events: DataFrame) -> DataFrame:
    """Packet rows: one trace per user, the event id as packet index."""
    return events.select(
        F.concat(F.lit("u"), _s(F.col("user_id"))).alias("trace_id"),
        F.col("event_id").alias("packet_index"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


def flows_raw(events: DataFrame) -> DataFrame:
    """Text flow records in the first public corpus' header spelling, dirty on purpose."""
    e = events.select("event_id", "user_id", "event_type", "value", _k().alias("k"))
    k, v = F.col("k"), F.col("value")
    return e.select(
        "event_id",
        F.concat(F.lit("f"), _s(F.col("user_id") % 2)).alias("source"),
        F.concat(F.lit(" "), F.when(F.col("event_type") == "error", F.lit("PortScan")).otherwise(F.lit("benign ")))
        .alias("Label"),
        _s(F.floor(v).cast("bigint")).alias("Total Fwd Packets"),
        F.when(k % 13 == 0, F.lit("n/a")).otherwise(_s(k % 5)).alias("Total Backward Packets"),
        _s(k % 3).alias("RST Flag Count"),
        _s(v * 1000.0).alias("Flow IAT Mean"),
        F.when(k % 10 == 0, F.lit("Infinity")).otherwise(_s(v * 2.0)).alias("Flow Packets/s"),
        _s(F.floor(v / 2.0).cast("bigint")).alias("act_data_pkt_fwd"),
        _s(k * 100).alias("Total Length of Fwd Packets"),
        _s(k * 60).alias("Total Length of Bwd Packets"),
        _s(v * 10000.0).alias(" Flow Duration"),
        F.when(k % 17 == 0, F.lit("-Infinity")).otherwise(_s(v * 50.0)).alias("Flow Bytes/s"),
        _s(v * 100.0).alias("Flow IAT Std"),
        F.when(F.col("user_id") % 2 == 1, F.lit("0")).otherwise(_s(k + 50)).alias("Packet Length Mean"),
        _s(k % 7 + 5).alias("Packet Length Std"),
        _s(k + 40).alias("Average Packet Size"),
        F.when(k % 19 == 0, F.lit("NaN")).otherwise(_s((k % 5).cast("double") / 4.0)).alias("Down/Up Ratio"),
        _s(k % 2).alias("SYN Flag Count"),
        _s(k % 11).alias("ACK Flag Count"),
        _s(k % 3).alias("PSH Flag Count"),
        _s(v * 20.0).alias("Active Mean"),
        _s(v * 8.0 + 1.0).alias("Idle Mean"),
    )


def sensor_aliased(events: DataFrame) -> DataFrame:
    """The raw sensor rows under alternative source spellings (timestamps as ISO text)."""
    raw = sensor_raw(events)
    return raw.select(
        F.col("session_id").alias("flow_id"),
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("time"),
        F.col("packets_sent").alias("packets_total"),
        F.col("packets_lost").alias("lost_packets"),
        F.col("rtt_ms").alias("latency_ms"),
        F.col("retransmissions").alias("retries"),
        F.col("resets").alias("connection_resets"),
        F.col("label").alias("target"),
        "flow_duration_ms",
        "average_packet_size",
        "domain",
    )


def decisions(events: DataFrame) -> DataFrame:
    """Transport decision log: one session outcome per event."""
    e = events.select("event_id", "user_id", "ts", "event_type", "value", _k().alias("k"))
    success = F.when(F.col("event_type") == "error", F.lit(0)).otherwise(F.lit(1))
    return e.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("isp-"), _s(F.col("user_id") % 10)).alias("isp_id"),
        F.when(F.col("event_type").isin("click", "view"), F.lit("web"))
        .when(F.col("event_type") == "purchase", F.lit("video"))
        .otherwise(F.lit("voice"))
        .alias("traffic_type"),
        F.hour(F.col("ts")).cast("int").alias("hour_bucket"),
        F.element_at(F.array(F.lit("quic"), F.lit("webrtc"), F.lit("doh")), (F.col("k") % 3 + 1).cast("int"))
        .alias("transport"),
        success.alias("success_count"),
        (F.lit(1) - success).alias("failure_count"),
        (F.lit(2) * success - F.lit(1)).alias("reward"),
        "event_type",
        "value",
    )


# Fixed values of the phase fixture: (pos, name, start s, end s, label, impairment, severity).
PHASES = [
    (0, "baseline", 0.0, 950400.0, 0, "none", "none"),
    (1, "impairment", 864000.0, 1814400.0, 1, "loss", "severe"),
]


def phase_table(events: DataFrame) -> DataFrame:
    """Experiment phases for the runs found in the data (``r0..r2``), two per run.

    Derived from the runs present in ``events``, so it stays one small row set per run.
    """
    runs = events.select(F.concat(F.lit("r"), _s(F.col("user_id") % 3)).alias("run_id")).distinct()
    spec = F.array(
        *[
            F.struct(
                F.lit(pos).alias("pos"),
                F.lit(name).alias("phase_name"),
                F.lit(start).alias("start_offset_seconds"),
                F.lit(end).alias("end_offset_seconds"),
                F.lit(label).alias("label"),
                F.lit(imp).alias("impairment_type"),
                F.lit(sev).alias("severity"),
            )
            for pos, name, start, end, label, imp, sev in PHASES
        ]
    )
    return runs.select("run_id", F.inline(spec))


def experiment_raw(events: DataFrame) -> DataFrame:
    """Sensor rows of three experiment runs (``run_id`` = user mod 3), no labels."""
    raw = sensor_raw(events)
    run = F.concat(F.lit("r"), F.substring("domain", 2, 20)).alias("run_id")
    return raw.select(run, *[c for c in raw.columns if c not in ("label", "domain")])


# Fixed values of the run fixture: application and scenario of every run.
RUN_APPLICATION = "browser"
RUN_SCENARIO = "loss-ramp"


def run_metadata(events: DataFrame) -> DataFrame:
    """Manifest scalars per run (domain, application, scenario), one row per run found in the data."""
    runs = events.select((F.col("user_id") % 3).alias("_r")).distinct()
    return runs.select(
        F.concat(F.lit("r"), _s(F.col("_r"))).alias("run_id"),
        F.concat(F.lit("d"), _s(F.col("_r"))).alias("domain"),
        F.lit(RUN_APPLICATION).alias("application"),
        F.lit(RUN_SCENARIO).alias("scenario"),
    )


def scores(events: DataFrame, window_seconds: int = 86400, variation_column: str = "rtt_cv") -> DataFrame:
    """Deterministic classifier output: rule score on the window features, with window label."""
    from netpulse.operators.ml import rule_score
    from netpulse.operators.windows import sensor_feature_frame

    feats = sensor_feature_frame(sensor_raw(events), window_seconds, extra_keys=("domain",))
    scored = rule_score(feats, variation_column=variation_column)
    # probabilities rounded to 6 places: ties are common and identical in both engines
    return scored.select("session_id", "domain", "window_start", "label", F.round("probability", 6).alias("probability"))


def packet_dump_rows(events: DataFrame) -> DataFrame:
    """Packet-dump shaped rows: per trace a 0-based line index (event order) and epoch seconds."""
    from netpulse.plans.ordering import row_index

    p = packets(events).select("trace_id", "packet_index", (F.unix_micros("timestamp") / F.lit(1e6)).alias("epoch"))
    return row_index(p, ["packet_index"], keys=["trace_id"], name="line").select(
        "trace_id", F.col("line").alias("packet_index"), "epoch"
    )
