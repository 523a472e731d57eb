"""Inter-arrival times and fixed-length history windows for next-gap forecasting.

Per-trace order is handled by ``ordered_history`` (range partitions + edge
pass), so a trace holding a third of all packets is still spread over many
tasks; statistics are plain global aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netpulse.functions.exprs import require_columns
from netpulse.operators.clean import parse_mixed_timestamps
from netpulse.plans.ordering import laid_out_history, lay_out, narrow_row_index, ordered_history, row_index

# Default gap ceiling (ms) and history length.
DEFAULT_MAX_IAT_MS = 5000.0
DEFAULT_SEQUENCE_LENGTH = 20


def inter_arrival_times(
    packets: DataFrame,
    trace_col: str = "trace_id",
    timestamp_col: str = "timestamp",
    index_col: str = "packet_index",
    max_iat_ms: float = DEFAULT_MAX_IAT_MS,
) -> DataFrame:
    """Gap to the previous packet of the trace in ms (order: packet index if present, else time);
    the difference is taken first, then rows outside ``0 < iat <= max_iat_ms`` are dropped. Rows without
    a trace are dropped. Without an index, ``packet_time_us`` keeps the order (gaps are positive, so
    no two rows of a trace share it)."""
    require_columns(packets, [trace_col, timestamp_col], "packet")
    has_index = index_col in packets.columns
    ts = parse_mixed_timestamps(timestamp_col, packets.schema[timestamp_col].dataType)
    cols = [F.col(trace_col).alias("trace_id"), F.unix_micros(ts).alias("_us")]
    if has_index:
        cols.append(F.col(index_col).alias("packet_index"))
    frame = packets.select(*cols).where(F.col("trace_id").isNotNull())
    order = ["packet_index", "_us"] if has_index else ["_us"]
    hist = ordered_history(frame, order, "_us", 1, keys=["trace_id"], out_col="_prev")
    iat = (F.col("_us") - F.element_at("_prev", -1)).cast("double") / F.lit(1000.0)
    out = hist.where(F.size("_prev") == 1).withColumn("iat_ms", iat)
    out = out.where((F.col("iat_ms") > 0.0) & (F.col("iat_ms") <= F.lit(float(max_iat_ms))))
    key = F.col("packet_index") if has_index else F.col("_us").alias("packet_time_us")
    return out.select("trace_id", key, "iat_ms")


def dump_inter_arrival_times(dump_rows: DataFrame, max_iat_ms: float = DEFAULT_MAX_IAT_MS) -> DataFrame:
    """Gaps of packet-dump rows (trace_id, packet_index from 0, epoch seconds):
    index 1..n-1, value rounded to 6 decimals before the range filter."""
    rows = dump_rows.select("trace_id", "packet_index", "epoch").where(F.col("trace_id").isNotNull())
    hist = ordered_history(rows, ["packet_index"], "epoch", 1,
                           keys=["trace_id"], out_col="_prev")
    iat = F.round((F.col("epoch") - F.element_at("_prev", -1)) * F.lit(1000.0), 6)
    out = hist.where(F.size("_prev") == 1).withColumn("iat_ms", iat)
    out = out.where((F.col("iat_ms") > 0.0) & (F.col("iat_ms") <= F.lit(float(max_iat_ms))))
    return out.select("trace_id", "packet_index", "iat_ms")


def iat_stats(iat: DataFrame) -> DataFrame:
    """Global mean and population standard deviation of ``iat_ms`` (0 or undefined -> 1)."""
    std = F.stddev_pop("iat_ms")
    return iat.agg(
        F.avg("iat_ms").alias("mean"),
        F.when(std.isNull() | (std == 0.0), F.lit(1.0)).otherwise(std).alias("std"),
    )


def _ordered_iat(iat: DataFrame) -> tuple[DataFrame, list[str]]:
    require_columns(iat, ["trace_id", "iat_ms"], "IAT")
    iat = iat.where(F.col("trace_id").isNotNull())
    if "packet_index" in iat.columns:
        return iat, ["packet_index"]
    if "packet_time_us" not in iat.columns:
        raise ValueError("gaps need packet_index or packet_time_us: rows have no order of their own")
    return row_index(iat, ["packet_time_us"], ["trace_id"], name="packet_index"), ["packet_index"]


def iat_sequences(
    iat: DataFrame,
    sequence_length: int = DEFAULT_SEQUENCE_LENGTH,
    stats: DataFrame | None = None,
    require_samples: bool = False,
) -> DataFrame:
    """One sample per IAT row with ``sequence_length`` earlier values in its trace:
    ``inputs`` (normalized history, oldest first) and ``target`` (normalized value).

    Normalization uses the global mean / population std of all rows (``iat_stats``).
    """
    frame, order = _ordered_iat(iat)
    laid = lay_out(frame, order, ["trace_id"])  # read by the statistics and by the history pass
    if stats is None:
        stats = iat_stats(laid)
    z = laid.crossJoin(F.broadcast(stats)).withColumn(  # one-row table
        "_z", (F.col("iat_ms") - F.col("mean")) / F.col("std")
    )
    hist = laid_out_history(z, "_z", sequence_length, ["trace_id"], "inputs")
    out = hist.where(F.size("inputs") == sequence_length).select(
        "trace_id", "packet_index", "inputs", F.col("_z").alias("target"), F.col("iat_ms").alias("actual_iat_ms"),
        "mean", "std",
    )
    if require_samples and out.limit(1).count() == 0:
        raise ValueError(f"no trace has more than {sequence_length} gaps")
    return out


def iat_inference_frame(iat: DataFrame, mean: float, std: float,
                        sequence_length: int = DEFAULT_SEQUENCE_LENGTH, require_samples: bool = True) -> DataFrame:
    """Samples for scoring with a stored mean/std; keeps the target's index and actual value.
    No sample at all is an error unless ``require_samples`` is false."""
    stats = iat.sparkSession.createDataFrame([(float(mean), float(std) or 1.0)], "mean double, std double")
    seq = iat_sequences(iat, sequence_length, stats=stats, require_samples=require_samples)
    return seq.select("trace_id", F.col("packet_index").alias("target_packet_index"), "inputs", "target",
                      "actual_iat_ms", "mean", "std")


def tail_split(samples: DataFrame, validation_ratio: float) -> DataFrame:
    """Mark the last ``max(1, floor(n * r))`` samples in (trace, index) order as validation.

    ``r`` outside [0, 1) raises; ``r = 0`` or fewer than 2 samples -> all train.
    """
    if not 0.0 <= validation_ratio < 1.0:
        raise ValueError(f"validation_ratio is {validation_ratio}; it must be at least 0 and below 1")
    indexed = narrow_row_index(samples, ["trace_id", "packet_index"], name="_pos")  # only the key is ranked
    n = indexed.agg(F.count(F.lit(1)).alias("_n"))
    k = F.greatest(F.lit(1), F.floor(F.col("_n").cast("double") * F.lit(float(validation_ratio))))
    valid = (F.lit(validation_ratio > 0.0)) & (F.col("_n") >= 2) & (F.col("_pos") >= F.col("_n") - k)
    out = indexed.crossJoin(F.broadcast(n))  # one-row table
    return out.withColumn("split", F.when(valid, F.lit("validation")).otherwise(F.lit("train"))).drop("_pos", "_n")
