"""Transport-decision log analytics: context features, outcomes, aggregates and bandit replay."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netpulse.plans.ordering import ROW_KEY, ordered_prefix, with_row_key

# Transports, their starting bandit scores (ties prefer the earlier one),
# the neutral success rate without history, and the recent-list limits.
TRANSPORTS = ("quic", "webrtc", "doh")
START_SCORES = {"quic": 0.6, "webrtc": 0.5, "doh": 0.2}
DEFAULT_SUCCESS_RATE = 0.5
RECENT_DEFAULT, RECENT_MIN, RECENT_MAX = 20, 1, 200
AGGREGATE_KEYS = ("isp_id", "traffic_type", "hour_bucket", "transport")


def hour_features(df: DataFrame, ts_col: str = "ts") -> DataFrame:
    """Cyclic time of day: sin/cos of 2*pi*(hour + minute/60)/24, plus the integer hour."""
    ts = F.col(ts_col)
    angle = F.lit(2.0 * math.pi) * ((F.hour(ts) + F.minute(ts) / F.lit(60.0)) / F.lit(24.0))
    return df.withColumns({"hour_sin": F.sin(angle), "hour_cos": F.cos(angle), "hour_bucket": F.hour(ts).cast("int")})


def session_outcomes(df: DataFrame, degraded_col: str = "degraded", echoed_col: str = "echoed") -> DataFrame:
    """Success = channel not degraded and payload echoed; reward +1/-1; success/failure counts."""
    ok = ~F.col(degraded_col) & F.col(echoed_col)
    return df.withColumns({
        "success": ok,
        "reward": F.when(ok, F.lit(1.0)).otherwise(F.lit(-1.0)),
        "success_count": F.when(ok, F.lit(1)).otherwise(F.lit(0)),
        "failure_count": F.when(ok, F.lit(0)).otherwise(F.lit(1)),
    })


def aggregate_sessions(df: DataFrame, keys: Sequence[str] = AGGREGATE_KEYS, daily: bool = False,
                       ts_col: str = "ts") -> DataFrame:
    """Success and failure sums per (isp, traffic type, hour, transport) [, day] — partial aggregation."""
    group = [F.col(k) for k in keys]
    if daily:
        group.append(F.to_date(F.col(ts_col)).alias("day"))
    return df.groupBy(*group).agg(
        F.coalesce(F.sum("success_count"), F.lit(0)).cast("bigint").alias("success_count"),
        F.coalesce(F.sum("failure_count"), F.lit(0)).cast("bigint").alias("failure_count"),
    )


def success_rate_by_context(aggregates: DataFrame, hours: Sequence[int] = tuple(range(24))) -> DataFrame:
    """Historical success rate per (isp, hour, traffic type); 0.5 for hours with no history.

    Every (isp, traffic type) seen gets all ``hours`` by a generator (no join with a grid);
    contexts come from the grouped history, so the input is read once.
    """
    hist = aggregates.groupBy("isp_id", "hour_bucket", "traffic_type").agg(
        F.sum("success_count").alias("_s"), F.sum("failure_count").alias("_f")
    )
    contexts = hist.select("isp_id", "traffic_type").distinct().withColumn(
        "hour_bucket", F.explode(F.array(*[F.lit(int(h)) for h in hours]))
    )
    j = contexts.join(hist, on=["isp_id", "hour_bucket", "traffic_type"], how="left")
    rate = F.try_divide(F.col("_s").cast("double"), (F.col("_s") + F.col("_f")).cast("double"))
    return j.select(
        "isp_id", "hour_bucket", "traffic_type",
        F.coalesce(rate, F.lit(DEFAULT_SUCCESS_RATE)).alias("historical_success_rate"),
    )


def choose_transport(log: DataFrame, agent_col: str = "isp_id", order_col: str = "event_id") -> DataFrame:
    """Offline replay of the greedy bandit: before each logged decision, every arm's score is its
    start score plus the rewards it earned earlier for the same agent; the max wins (ties in
    quic, webrtc, doh order). Running sums use the distributed ordered prefix, which takes the agent, the order and the rewards
    only: a log with more columns is joined back on a key of its rows."""
    needed = list(dict.fromkeys([agent_col, order_col, "transport", "reward"]))
    wide = bool(set(log.columns) - set(needed))
    rows = with_row_key(log) if wide else log
    own = [ROW_KEY] if wide else []
    per_arm = {t: F.when(F.col("transport") == t, F.col("reward").cast("double")).otherwise(F.lit(0.0)) for t in TRANSPORTS}
    marked = rows.select(*needed, *own).withColumns({f"_r_{t}": e for t, e in per_arm.items()})
    pref = ordered_prefix(marked, [order_col, *own], [f"_r_{t}" for t in TRANSPORTS], keys=[agent_col])
    scores = {t: F.lit(START_SCORES[t]) + F.col(f"cum__r_{t}") for t in TRANSPORTS}
    ranked = F.array(*[
        F.struct(scores[t].alias("score"), F.lit(len(TRANSPORTS) - i).alias("priority"), F.lit(t).alias("transport"))
        for i, t in enumerate(TRANSPORTS)
    ])
    best = F.array_max(ranked)
    out = pref.select(
        *(own if wide else log.columns),
        *[scores[t].alias(f"score_{t}") for t in TRANSPORTS],
        best["transport"].alias("chosen_transport"),
        best["score"].alias("chosen_score"),
    )
    return rows.join(out, ROW_KEY).select(*log.columns, *out.columns[1:]) if wide else out


def recent_aggregates(aggregates: DataFrame, limit: int | None = RECENT_DEFAULT, id_col: str = "id") -> DataFrame:
    """Newest rows by id; the limit is clamped to [1, 200] (a top-k, no full sort)."""
    n = max(RECENT_MIN, min(int(limit if limit is not None else RECENT_DEFAULT), RECENT_MAX))
    return aggregates.orderBy(F.col(id_col).desc()).limit(n)


def validate_aggregates(df: DataFrame) -> Column:
    """Row check of an incoming aggregate: known transport, no missing field (counts may be any integer)."""
    present = F.lit(True)
    for c in (*AGGREGATE_KEYS, "success_count", "failure_count"):
        present = present & F.col(c).isNotNull()
    return F.coalesce(
        present & F.col("transport").isin(*TRANSPORTS),
        F.lit(False),
    )


def ingest_session_aggregates(df: DataFrame, created_at: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """Split incoming aggregates into (accepted rows stamped with ``created_at``, rejects)."""
    stamp = F.lit(created_at or datetime.now(timezone.utc)).cast("timestamp")
    flagged = df.withColumn("_valid", validate_aggregates(df))
    accepted = flagged.where("_valid").drop("_valid").select(*AGGREGATE_KEYS, "success_count", "failure_count",
                                                             *[c for c in df.columns if c not in (*AGGREGATE_KEYS,
                                                               "success_count", "failure_count")],
                                                             stamp.alias("created_at"))
    rejected = flagged.where(~F.col("_valid")).drop("_valid")
    return accepted, rejected


def append_aggregates(accepted: DataFrame, path: str) -> None:
    """Append accepted aggregates to the store (a parquet table)."""
    accepted.write.mode("append").parquet(path)
