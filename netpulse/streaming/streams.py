"""Structured Streaming forms: live window features, session baselines in state, alerts,
ping lines as they arrive, idempotent aggregate ingest and running bandit scores.

Lateness is explicit: windows are emitted in append mode once the watermark
(max event time seen minus ``delay``) passes their end; rows older than the
previous micro-batch's watermark are dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from netpulse.functions.exprs import require_columns
from netpulse.operators import decisions as D
from netpulse.operators.ml import RULE_THRESHOLD, rule_score
from netpulse.operators.windows import (
    _BASELINE_OUTPUT,
    BASELINE_FEATURES,
    UNLABELLED_COLUMNS,
    window_aggregate_exprs,
    window_features,
)
from netpulse.sources.io import fresh_folder as scratch
from netpulse.sources.io import parse_ping_log


def stream_table(spark: SparkSession, directory: str, name: str, schema: T.StructType | None = None,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files named ``name.parquet`` (or ``name*.parquet``) under ``directory`` as a stream."""
    reader = spark.readStream.schema(schema or spark.read.parquet(f"{directory}/{name}.parquet").schema)
    reader = reader.option("pathGlobFilter", f"{name}*.parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return reader.parquet(directory)


def run_available_now(df: DataFrame, path: str | None = None, mode: str = "append", fmt: str = "parquet",
                      name: str = "stream") -> str:
    """Run a streaming query over everything available now into a parquet sink; return the sink path."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    q = (df.writeStream.format(fmt).outputMode(mode).option("path", f"{path}/data")
         .option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return f"{path}/data"


# ------------------------------------------------------------------ window features


def stream_window_features(raw: DataFrame, window_seconds: int = 5, delay: str = "1 minute",
                           extra_keys: tuple[str, ...] = ()) -> DataFrame:
    """Window aggregation + window-local features on a stream (append mode, watermark ``delay``); with the label if rows have one."""
    require_columns(raw, UNLABELLED_COLUMNS, "sensor")
    frame = raw.withColumn("timestamp", F.col("timestamp").cast("timestamp")).where(
        F.col("session_id").isNotNull() & F.col("timestamp").isNotNull()
    ).withWatermark("timestamp", delay)
    win = F.window("timestamp", f"{int(window_seconds)} seconds")
    agg = frame.groupBy(F.col("session_id"), *[F.col(k) for k in extra_keys], win.alias("_w")).agg(
        *window_aggregate_exprs(frame.columns))
    agg = agg.withColumn("window_start", F.col("_w.start")).drop("_w")
    return window_features(agg, window_seconds)


# ------------------------------------------------------------------ session baseline in state

#: rows of a session that a task holds while it looks for the session's first values; more go to the state store
HELD_ROWS = 10_000


def _baseline_output_schema(window_schema: T.StructType) -> T.StructType:
    fields = [f for f in window_schema.fields if f.name != "label"]
    fields += [T.StructField(_BASELINE_OUTPUT[c], T.DoubleType()) for c in BASELINE_FEATURES]
    fields += [f for f in window_schema.fields if f.name == "label"]
    return T.StructType(fields)


class SessionBaseline(StatefulProcessor):
    """First non-null values of the baseline features of a session, in one value state; rows leave piece by piece.

    Once all values are known, rows pass straight through. In a batch in which some are not known yet, they are found first: its rows wait
    in memory up to ``HELD_ROWS`` and beyond that in a list in the state store, which is emptied before the batch ends."""

    def __init__(self, schema: T.StructType, timeout_ms: int | None) -> None:
        self.schema, self.timeout_ms = schema, timeout_ms
        self.columns = [f.name for f in schema.fields]
        self.out = [c for c in self.columns if c != "label"] + [_BASELINE_OUTPUT[c] for c in BASELINE_FEATURES] + [c for c in self.columns if c == "label"]

    def init(self, handle) -> None:
        self.handle = handle
        self.starts = handle.getValueState("starts", T.StructType([T.StructField(c, T.DoubleType()) for c in BASELINE_FEATURES]))
        self.waiting = handle.getListState("waiting", self.schema)

    def _relative(self, rows: pd.DataFrame, start: dict) -> pd.DataFrame:
        new = {}
        for c, (kind, floor) in BASELINE_FEATURES.items():
            s, values = start.get(c), rows[c].to_numpy(dtype=float)
            if s is None:
                new[_BASELINE_OUTPUT[c]] = np.full(len(rows), np.nan)
            else:
                new[_BASELINE_OUTPUT[c]] = values - s if kind == "delta" else values / max(s, floor)
        return pd.DataFrame({c: new[c] if c in new else rows[c].array for c in self.out})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.starts.get()  # None for a new session
        start = {c: v for c, v in zip(BASELINE_FEATURES, known or (), strict=False) if v is not None}
        unknown = [c for c in BASELINE_FEATURES if c not in start]
        first: dict[str, tuple] = {}
        held, n_held, spilled = [], 0, False
        for part in rows:
            if part.empty:
                continue
            if not unknown:
                yield self._relative(part, start)
                continue
            times = part["window_start"].to_numpy()
            for c in unknown:
                values = part[c].to_numpy(dtype=float)
                there = np.flatnonzero(~np.isnan(values))
                if len(there):
                    i = there[times[there].argmin()]
                    if c not in first or times[i] < first[c][0]:
                        first[c] = (times[i], float(values[i]))
            held.append(part)
            n_held += len(part)
            if n_held >= HELD_ROWS:
                for p in held:
                    self.waiting.appendList([tuple(None if pd.isna(v) else v for v in r) for r in p[self.columns].astype(object).itertuples(index=False)])
                held, n_held, spilled = [], 0, True
        if first:
            start |= {c: value for c, (_, value) in first.items()}
            self.starts.update(tuple(start.get(c) for c in BASELINE_FEATURES))
        for part in held:
            yield self._relative(part, start)
        if spilled:
            stored = self.waiting.get()
            while piece := list(islice(stored, HELD_ROWS)):
                yield self._relative(pd.DataFrame(piece, columns=self.columns), start)
            self.waiting.clear()
        if self.timeout_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.starts.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_session_baseline(window_rows: DataFrame, delay: str = "1 minute",
                            session_timeout_ms: int | None = None) -> DataFrame:
    """The 7 session-relative features on a stream of window rows: the first non-null value of
    each baseline feature per session is kept in state (``SessionBaseline``).

    By default a session keeps its baseline for good, as in batch. ``session_timeout_ms`` evicts
    sessions without data for that much event time; one that comes back later starts a new baseline,
    which changes results."""
    rows = window_rows.withWatermark("window_start", delay)
    return rows.groupBy("session_id").transformWithStateInPandas(
        SessionBaseline(window_rows.schema, session_timeout_ms), _baseline_output_schema(window_rows.schema), "append",
        "none" if session_timeout_ms is None else "eventTime")


def stream_alerts(features: DataFrame, threshold: float = RULE_THRESHOLD, model=None) -> DataFrame:
    """Rows whose rule score (or model probability) reaches the threshold — stateless."""
    if model is not None:
        from netpulse.operators.ml import score

        scored = score(model, features, threshold)
    else:
        scored = rule_score(features, threshold)
    return scored.where(F.col("degraded"))


# ------------------------------------------------------------------ ping lines, ingest, bandit scores


def stream_ping_rows(spark: SparkSession, directory: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Ping output files as they arrive -> probe events; lines without ``[epoch]`` get ingestion time."""
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    parsed = parse_ping_log(reader.text(directory))
    return parsed.withColumn(
        "timestamp", F.coalesce(F.timestamp_micros((F.col("epoch") * F.lit(1e6)).cast("bigint")), F.current_timestamp())
    )


def ingest_batch(store_path: str, rejects_path: str | None = None):
    """``foreachBatch`` writer: validate, stamp, write the batch under its id (overwrite -> idempotent on replay)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        accepted, rejected = D.ingest_session_aggregates(batch, created_at=datetime.now(timezone.utc))
        accepted.write.mode("overwrite").parquet(f"{store_path}/batch_id={batch_id}")
        if rejects_path:
            rejected.write.mode("overwrite").parquet(f"{rejects_path}/batch_id={batch_id}")

    return write


def stream_ingest_aggregates(incoming: DataFrame, store_path: str, checkpoint: str,
                             rejects_path: str | None = None):
    """Start the ingest stream (one output folder per micro-batch, safe to replay)."""
    return (incoming.writeStream.foreachBatch(ingest_batch(store_path, rejects_path))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_transport_scores(log: DataFrame) -> DataFrame:
    """Running bandit score per (agent, transport): start score + sum of rewards (update/complete mode)."""
    start = F.create_map(*[x for t, s in D.START_SCORES.items() for x in (F.lit(t), F.lit(s))])
    agg = log.groupBy("isp_id", "transport").agg(F.sum(F.col("reward").cast("double")).alias("reward_sum"),
                                                  F.count(F.lit(1)).alias("decisions"))
    return agg.withColumn("score", F.coalesce(start[F.col("transport")], F.lit(0.0)) + F.col("reward_sum"))


SCORE_KEYS = ("isp_id", "transport")


def versioned_writer(path: str, keys: tuple[str, ...] = SCORE_KEYS, whole_every: int = 50):
    """``foreachBatch`` writer of an update-mode table: every batch's changed keys go to a folder of their own, never over another's.

    A batch counts once its line in ``commits`` is there, which is written last (one row, so one file, by rename). A batch that is replayed is written
    again beside its first copy; its latest line counts. Each ``whole_every``-th batch stores all keys, and readers start from there."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = f"batch={batch_id:012d}-{uuid.uuid4().hex}"
        whole = batch_id % whole_every == 0
        if whole and batch_id > 0:
            batch = newest(read_versioned(spark, path, keys, below=batch_id).withColumn("_version", F.lit(0)).unionByName(
                batch.withColumn("_version", F.lit(1))), keys, "_version")
        batch.write.parquet(f"{path}/data/{folder}")
        done = [(batch_id, folder, whole, datetime.now(timezone.utc).timestamp())]
        spark.createDataFrame(done, COMMITS).coalesce(1).write.mode("append").json(f"{path}/commits")

    return write


COMMITS = "batch_id long, folder string, whole boolean, at double"


def newest(rows: DataFrame, keys: tuple[str, ...], version: str) -> DataFrame:
    """The row of the highest version of each key."""
    others = [c for c in rows.columns if c not in (*keys, version)]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), version).alias("_v"))
    return best.select(*keys, *[F.col(f"_v.{c}") for c in others])


def read_versioned(spark: SparkSession, path: str, keys: tuple[str, ...] = SCORE_KEYS, below: int | None = None) -> DataFrame:
    """The newest row of every key over the committed batches (those before ``below``): a batch that is being written is not seen."""
    commits = spark.read.schema(COMMITS).json(f"{path}/commits")
    if below is not None:
        commits = commits.where(F.col("batch_id") < below)
    commits = commits.groupBy("batch_id").agg(F.max_by(F.struct("folder", "whole"), "at").alias("c")).select("batch_id", "c.*")
    start = commits.where("whole").agg(F.max("batch_id")).first()[0]
    # at most as many folders as there are batches between two whole ones
    folders = [r["folder"] for r in commits.where(F.col("batch_id") >= (start or 0)).select("folder").collect()]
    if not folders:
        raise ValueError(f"no batch is committed at {path}")
    rows = spark.read.parquet(*[f"{path}/data/{f}" for f in folders])
    batch = F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)-", 1).cast("long")
    return newest(rows.withColumn("_batch", batch), keys, "_batch")


def stream_scores_to(log: DataFrame, path: str, checkpoint: str):
    """Start the stream that keeps the running scores of ``log`` at ``path`` (update mode: only keys that changed are written)."""
    return (stream_transport_scores(log).writeStream.outputMode("update").foreachBatch(versioned_writer(path))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
