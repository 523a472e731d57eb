"""Spark session settings the library relies on.

The operators assume UTC session time (all timestamps in the data model are
UTC) and ANSI mode (bad casts raise unless written with ``try_cast``).
On a cluster the session is created by the platform; ``configure`` only fills
in what is unset and never overrides a checkpoint directory that the cluster
already names.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


# Settings applied only where the session leaves them unset.
_DEFAULTS = {
    # per-session stream state can be large; RocksDB keeps it off the JVM heap
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators need to an existing session."""
    for key, value in _REQUIRED.items():
        spark.conf.set(key, value)
    for key, value in _DEFAULTS.items():
        if not spark.conf.get(key, None):
            spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    Reads ``spark.checkpoint.dir`` (set by the cluster). Only when it is unset,
    as in local tests, a scratch folder is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # a single-machine session without a shared folder (tests, the bench)
        configured = tempfile.mkdtemp(prefix="netpulse-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "netpulse") -> SparkSession:
    """A local session for tests and the bench (UI off, UTC, ANSI, AQE)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("NETPULSE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in _REQUIRED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def materialize(df):
    """Cut lineage and compute once: a reliable checkpoint in the shared checkpoint folder.

    Used where one intermediate feeds several branches of a plan (the branches
    would otherwise each rescan and reshuffle the input).
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df):
    """Like ``materialize``, as Parquet files in the shared checkpoint folder: computed once, and readers take only the columns they need.
    For wide rows that many jobs read."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: a table of at most this many (narrow) rows may be sent to every task
BROADCAST_ROWS = 200_000


def small(df, most: int | None = None):
    """Compute a lookup table once and count it: marked for broadcast up to ``most`` (``BROADCAST_ROWS``) rows. A larger one
    is returned as a plain scan, so that a join shuffles it and adaptive execution can split hot keys."""
    from pyspark.sql import functions as F

    df = materialize(df)
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df
