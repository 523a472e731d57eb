import os
from datetime import datetime, timedelta

import duckdb
import pytest

import __spark_entry__ as E
from netpulse.operators import ml as ML
from netpulse.sources import io as IO
from tests.test_ml import b2_features

ALL = ["hist_gradient_boosting", "lightgbm", "lightgbm_sigmoid", "logistic_regression", "random_forest"]


def test_a_comparison_holds_a_calibrated_model(spark):
    """Its folds are fitted side by side in a thread of the comparison, which has no active session."""
    ranked = ML.compare_models(b2_features(spark, ("a", "b")), ("lightgbm_sigmoid", "logistic_regression"), 0.5, num_trees=2).collect()
    assert sorted((r["algorithm"], r["rows"]) for r in ranked) == [("lightgbm_sigmoid", 12), ("logistic_regression", 12)]


@pytest.fixture()
def small_events(spark, tmpdir_path):
    """The folder of an events table of 12 users over 4 days, a third of them errors."""
    kinds = ("view", "error", "click")
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=i // 3), i % 12, kinds[(i + i // 36) % 3], float(i * 7 % 50), '{"k": %d}' % (i * 5 % 97)) for i in range(288)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmpdir_path}/events.parquet")
    return tmpdir_path


def test_every_registry_estimator_is_built(spark, small_events, monkeypatch):
    monkeypatch.setattr(ML, "DEFAULT_TREES", 2)
    windows = E.queries()["sensor_feature_frame"](spark, small_events).count()
    scored = E.queries()["build_estimator"](spark, small_events).groupBy("algorithm").count().collect()
    assert sorted((r["algorithm"], r["count"]) for r in scored) == [(a, windows) for a in ALL]


def test_every_registry_estimator_is_compared(spark, small_events, monkeypatch):
    monkeypatch.setattr(ML, "DEFAULT_TREES", 2)
    out = E.queries()["compare_models_counts"](spark, small_events)
    sql = E.oracle_sql()["compare_models_counts"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{small_events}/events.parquet/*.parquet')")
    wanted = con.execute(f"SELECT {', '.join(out.columns)} FROM ({sql})").fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(wanted) and sorted(r[0] for r in wanted) == ALL


def test_the_folders_of_a_dump_are_made_in_many_tasks(spark, small_events, monkeypatch):
    """Making a trace's folder takes a task longer than writing its few lines, so the bytes must not decide how many tasks there are."""
    seen = []
    read = IO.read_packet_dump
    monkeypatch.setattr(IO, "read_packet_dump", lambda s, path, **how: seen.append(path) or read(s, path, **how))
    out = E.queries()["read_packet_dump"](spark, small_events)
    rows = [tuple(r) for r in out.select("trace_id", "packet_index", "epoch").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{small_events}/events.parquet/*.parquet')")
    assert sorted(rows) == sorted(con.execute(E.oracle_sql()["read_packet_dump"]).fetchall()) and len(rows) == 288
    tasks = {f.split("-")[1] for _, _, files in os.walk(seen[0].removeprefix("file:")) for f in files if f.startswith("part-")}
    assert len(tasks) >= min(12, 2 * spark.sparkContext.defaultParallelism)
