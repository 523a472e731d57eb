"""Tumbling-window aggregation and the 30-column sensor feature frame.

Plan shape (the one that holds at scale):

1. ``groupBy(session_id, window(timestamp))`` — one hash aggregate with
   map-side partial aggregation, so raw rows are combined before the only
   shuffle of raw data. A session holding a third of all rows is still spread
   over its windows.
2. ratio features — a projection, fused into the same codegen stage.
3. session baseline — ``groupBy(session_id)`` of the (much smaller) window rows
   with partial ``min_by`` aggregates, joined back on ``session_id``. AQE turns
   the join into a broadcast when the measured baseline side is small and
   splits a hot session on the probe side otherwise (skew join). No window
   function keeps a whole session in one task. The window rows are
   checkpointed once, so the raw scan and its shuffle run a single time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netpulse.functions.exprs import as_utc_timestamp, clip_lower, require_columns

# The raw sensor schema, the optional per-flow columns with the
# aggregate each one gets inside a window, and the 30 output features in order.
RAW_SENSOR_COLUMNS = [
    "session_id",
    "timestamp",
    "packets_sent",
    "packets_lost",
    "rtt_ms",
    "retransmissions",
    "resets",
    "label",
]
UNLABELLED_COLUMNS = [c for c in RAW_SENSOR_COLUMNS if c != "label"]  # what rows to be scored must have

OPTIONAL_COLUMN_AGGREGATES = {
    "flow_duration_ms": "mean",
    "flow_packets_per_second": "mean",
    "flow_bytes_per_second": "mean",
    "average_packet_size": "mean",
    "packet_length_mean": "mean",
    "packet_length_std": "mean",
    "fwd_packet_count": "sum",
    "bwd_packet_count": "sum",
    "fwd_byte_count": "sum",
    "bwd_byte_count": "sum",
    "down_up_ratio": "mean",
    "flow_iat_mean_us": "mean",
    "flow_iat_std_us": "mean",
    "active_mean_us": "mean",
    "idle_mean_us": "mean",
    "syn_flag_count": "sum",
    "ack_flag_count": "sum",
    "psh_flag_count": "sum",
}

FEATURE_COLUMNS = [
    "packet_loss_ratio",
    "packets_per_second",
    "packets_total_log1p",
    "packets_lost_log1p",
    "rtt_mean_ms",
    "rtt_cv",
    "retransmission_ratio",
    "retransmissions_log1p",
    "reset_ratio",
    "sample_count",
    "flow_duration_ms",
    "flow_packets_per_second",
    "flow_bytes_per_second",
    "average_packet_size",
    "packet_length_cv",
    "fwd_backward_packet_ratio",
    "fwd_backward_byte_ratio",
    "down_up_ratio",
    "flow_iat_cv",
    "active_idle_ratio",
    "syn_flag_ratio",
    "ack_flag_ratio",
    "psh_flag_ratio",
    "packet_loss_ratio_delta",
    "rtt_mean_ratio_to_session_start",
    "packets_per_second_ratio_to_session_start",
    "retransmission_ratio_delta",
    "flow_bytes_per_second_ratio_to_session_start",
    "flow_iat_cv_delta",
    "active_idle_ratio_to_session_start",
]

# Session-start reference values: feature -> (kind, floor of the start value).
BASELINE_FEATURES = {
    "packet_loss_ratio": ("delta", None),
    "rtt_mean_ms": ("ratio", 1e-6),
    "packets_per_second": ("ratio", 1e-6),
    "retransmission_ratio": ("delta", None),
    "flow_bytes_per_second": ("ratio", 1.0),
    "flow_iat_cv": ("delta", None),
    "active_idle_ratio": ("ratio", 1e-6),
}
_BASELINE_OUTPUT = {
    "packet_loss_ratio": "packet_loss_ratio_delta",
    "rtt_mean_ms": "rtt_mean_ratio_to_session_start",
    "packets_per_second": "packets_per_second_ratio_to_session_start",
    "retransmission_ratio": "retransmission_ratio_delta",
    "flow_bytes_per_second": "flow_bytes_per_second_ratio_to_session_start",
    "flow_iat_cv": "flow_iat_cv_delta",
    "active_idle_ratio": "active_idle_ratio_to_session_start",
}

_SUMMED_RAW = ["packets_sent", "packets_lost", "retransmissions", "resets"]


def window_start_column(ts: Column, window_seconds: int) -> Column:
    """Epoch-aligned tumbling window start (``window()`` is epoch aligned)."""
    return F.window(ts, f"{int(window_seconds)} seconds").start


def label_of(frame: DataFrame) -> list[str]:
    """``label``, where there is one: rows to be scored have none."""
    return ["label"] if "label" in frame.columns else []


def window_aggregate_exprs(columns: list[str]) -> list[Column]:
    """Aggregate expressions of one tumbling window (shared by batch and stream)."""
    aggs = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _SUMMED_RAW]  # whole numbers stay so, fractions are kept
    aggs += [
        F.avg("rtt_ms").alias("rtt_mean"),
        F.coalesce(F.stddev_samp("rtt_ms"), F.lit(0.0)).alias("rtt_std"),
        F.count("timestamp").alias("sample_count"),
    ]
    if "label" in columns:
        aggs.append(F.max("label").alias("label"))
    for name, how in OPTIONAL_COLUMN_AGGREGATES.items():
        if name in columns:
            value = F.col(name).cast("double")
            agg = F.avg(value) if how == "mean" else F.sum(value)
            aggs.append(agg.alias(name))
    return aggs


def _prepare_raw(raw: DataFrame) -> DataFrame:
    require_columns(raw, UNLABELLED_COLUMNS, "sensor")
    ts_type = raw.schema["timestamp"].dataType
    # Null group keys are dropped (the reference's groupby does so); Spark would keep them.
    return raw.withColumn("timestamp", as_utc_timestamp("timestamp", ts_type)).where(
        F.col("session_id").isNotNull() & F.col("timestamp").isNotNull()
    )


def window_aggregate(raw: DataFrame, window_seconds: int = 5, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Per (session, tumbling window) sums, RTT mean/std, counts and optional columns; the label if the rows have one."""
    frame = _prepare_raw(raw)
    keys = [F.col("session_id"), *[F.col(k) for k in extra_keys]]
    grouped = frame.groupBy(*keys, window_start_column(F.col("timestamp"), window_seconds).alias("window_start"))
    return grouped.agg(*window_aggregate_exprs(frame.columns))


def _optional(df: DataFrame, name: str) -> Column:
    if name in df.columns:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return F.lit(0.0)


def window_features(windows: DataFrame, window_seconds: int = 5) -> DataFrame:
    """The 23 window-local features: guarded ratios and log counts."""
    total = F.greatest(F.col("packets_sent") + F.col("packets_lost"), F.lit(1)).cast("double")
    lost = F.col("packets_lost").cast("double")
    retrans = F.col("retransmissions").cast("double")
    samples = F.greatest(F.col("sample_count"), F.lit(1)).cast("double")
    seconds = float(max(int(window_seconds), 1))

    def opt(name: str) -> Column:
        return _optional(windows, name)

    features = {
        "packet_loss_ratio": lost / total,
        "packets_per_second": total / F.lit(seconds),
        "packets_total_log1p": F.log1p(total),
        "packets_lost_log1p": F.log1p(lost),
        "rtt_mean_ms": F.col("rtt_mean").cast("double"),
        "rtt_cv": F.col("rtt_std") / clip_lower("rtt_mean", 1e-6),
        "retransmission_ratio": retrans / total,
        "retransmissions_log1p": F.log1p(retrans),
        "reset_ratio": F.col("resets").cast("double") / samples,
        "sample_count": F.col("sample_count").cast("double"),
        "flow_duration_ms": opt("flow_duration_ms"),
        "flow_packets_per_second": opt("flow_packets_per_second"),
        "flow_bytes_per_second": opt("flow_bytes_per_second"),
        "average_packet_size": opt("average_packet_size"),
        "packet_length_cv": opt("packet_length_std") / F.greatest(opt("packet_length_mean"), F.lit(1e-6)),
        "fwd_backward_packet_ratio": opt("fwd_packet_count") / F.greatest(opt("bwd_packet_count"), F.lit(1.0)),
        "fwd_backward_byte_ratio": opt("fwd_byte_count") / F.greatest(opt("bwd_byte_count"), F.lit(1.0)),
        "down_up_ratio": opt("down_up_ratio"),
        "flow_iat_cv": opt("flow_iat_std_us") / F.greatest(opt("flow_iat_mean_us"), F.lit(1.0)),
        "active_idle_ratio": opt("active_mean_us") / F.greatest(opt("idle_mean_us"), F.lit(1.0)),
        "syn_flag_ratio": opt("syn_flag_count") / total,
        "ack_flag_ratio": opt("ack_flag_count") / total,
        "psh_flag_ratio": opt("psh_flag_count") / total,
    }
    keys = [c for c in windows.columns if c not in set(RAW_SENSOR_COLUMNS[2:]) | set(OPTIONAL_COLUMN_AGGREGATES)
            and c not in {"rtt_mean", "rtt_std", "sample_count", "label"}]
    return windows.select(*keys, *[e.alias(n) for n, e in features.items()], *label_of(windows))


def session_start_values(features: DataFrame, session_key: str = "session_id") -> DataFrame:
    """First non-null value of each baseline feature per session, by window start.

    ``min_by`` with a NULL ordering value for NULL inputs skips them, which is
    the "first non-missing" rule; it aggregates partially before the shuffle.
    """
    aggs = [
        F.min_by(F.col(name), F.when(F.col(name).isNotNull(), F.col("window_start"))).alias(f"_start_{name}")
        for name in BASELINE_FEATURES
    ]
    return features.groupBy(session_key).agg(*aggs)


def session_baseline_features(features: DataFrame, session_key: str = "session_id") -> DataFrame:
    """Add the 7 features relative to the session's first window.

    The start values (one row per session) are a plain join side: adaptive execution measures it, broadcasts it while it is
    small and can split a hot session's rows otherwise. Nothing is written; callers that read the result several times
    materialize it themselves.
    """
    starts = session_start_values(features, session_key)
    joined = features.join(starts, on=session_key, how="left")
    derived = []
    for name, (kind, floor) in BASELINE_FEATURES.items():
        start = F.col(f"_start_{name}")
        if kind == "delta":
            value = F.col(name) - start
        else:
            value = F.col(name) / clip_lower(start, floor)
        derived.append(value.alias(_BASELINE_OUTPUT[name]))
    keep = [c for c in features.columns if c != "label"]
    return joined.select(*keep, *derived, *label_of(features))


def sensor_feature_frame(raw: DataFrame, window_seconds: int = 5, extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Raw sensor rows -> one row per (session, window) with the 30 features, and the label if the rows have one.

    ``extra_keys`` are carried through as grouping keys (e.g. ``domain``).
    """
    windows = window_aggregate(raw, window_seconds, extra_keys)
    feats = window_features(windows, window_seconds)
    out = session_baseline_features(feats)
    return out.select("session_id", *extra_keys, "window_start", *FEATURE_COLUMNS, *label_of(out))


# ---------------------------------------------------------------- counts


def session_labels(features: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Max label per session (optionally per domain too)."""
    return features.groupBy(*keys).agg(F.max("label").alias("label"))


def class_balance(df: DataFrame) -> DataFrame:
    return df.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


def rows_by_domain(df: DataFrame) -> DataFrame:
    return df.groupBy("domain").agg(F.count(F.lit(1)).alias("rows"))


def class_balance_by_domain(df: DataFrame) -> DataFrame:
    return df.groupBy("domain", "label").agg(F.count(F.lit(1)).alias("rows"))


def dataset_summary(df: DataFrame) -> DataFrame:
    """Rows and distinct sessions per domain."""
    return df.groupBy("domain").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("session_id").alias("sessions")
    )
