import os
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netpulse.operators import ml as ML
from netpulse.sources import io as IO
from netpulse.streaming import streams as ST
from tests.test_ml import b2_features


def counted(features):
    """``features`` and an accumulator of how many rows were computed."""
    spark = features.sparkSession
    seen = spark.sparkContext.accumulator(0)

    def count(label):
        seen.add(1)
        return label

    rows = spark.createDataFrame(features.collect(), features.schema)
    return rows.withColumn("label", F.udf(count, features.schema["label"].dataType).asNondeterministic()("label")), seen, rows.count()


JOBS = {
    "train": lambda f: ML.train_sensor(f, "logistic_regression", 0.5)[1],
    "multidomain": lambda f: ML.train_sensor_multidomain(f, "logistic_regression", 0.5)[1],
    "compare": lambda f: ML.compare_models(f, ("logistic_regression", "random_forest"), 0.5, num_trees=2),
    "transfer": lambda f: ML.evaluate_transfer(f, f.withColumn("domain", F.lit("b")), "logistic_regression"),
}


@pytest.mark.parametrize("job", JOBS)
def test_features_are_computed_once(spark, job):
    features, seen, rows = counted(b2_features(spark))
    assert JOBS[job](features).count() > 0
    assert seen.value == rows * (2 if job == "transfer" else 1)  # source and target there


def test_small_fits_take_few_tasks(spark):
    frame = b2_features(spark).repartition(8)
    assert ML.for_fit(frame).rdd.getNumPartitions() == 1 and ML.for_fit(frame).count() == frame.count()


def test_dump_by_folder_lists_no_files_on_the_driver(spark, tmpdir_path, monkeypatch):
    for trace in ("a", "b"):
        os.makedirs(os.path.join(tmpdir_path, f"trace={trace}"))
        with open(os.path.join(tmpdir_path, f"trace={trace}", "x.txt"), "w") as f:
            f.write("1.5 IP\nno number\n2.5 IP\n")
    monkeypatch.setattr(DataFrame, "inputFiles", lambda self: pytest.fail("the driver asked for every file"))
    got = sorted(tuple(r) for r in IO.read_packet_dump(spark, tmpdir_path, by_folder=True).collect())
    assert got == [(f"trace={t}", i, e) for t in ("a", "b") for i, e in ((0, 1.5), (1, 2.5))]


class Value:
    def __init__(self):
        self.value, self.calls = None, 0

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


class Handle:
    def __init__(self):
        self.values = []

    def getValueState(self, name, schema, *args):
        self.values.append(Value())
        return self.values[-1]

    def getListState(self, name, schema, *args):
        return None


def test_a_session_asks_the_state_store_twice():
    """Each call is a round trip from the Python worker: one read and one write a session and batch, none to write what is known."""
    schema = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("window_start", T.TimestampType()),
                           *[T.StructField(c, T.DoubleType()) for c in ST.BASELINE_FEATURES]])
    handle, processor = Handle(), ST.SessionBaseline(schema, None)
    processor.init(handle)
    t0 = datetime(2026, 4, 6)
    late = next(iter(ST.BASELINE_FEATURES))  # has no value at first
    rows = pd.DataFrame([["s", t0 + timedelta(days=d), *[None if d == 1 and c == late else float(d + k) for k, c in enumerate(ST.BASELINE_FEATURES)]]
                         for d in (3, 1, 2)], columns=schema.names)
    calls = lambda: sum(v.calls for v in handle.values)
    out = pd.concat(processor.handleInputRows(("s",), iter([rows]), None)).set_index("window_start")
    assert calls() == 2
    name = ST._BASELINE_OUTPUT[late]
    assert out[name][t0 + timedelta(days=3)] == 1.0 and out[name][t0 + timedelta(days=2)] == 0.0 and pd.isna(out[name][t0 + timedelta(days=1)])
    later = pd.concat(processor.handleInputRows(("s",), iter([rows[:1]]), None))
    assert calls() == 3 and later[name].tolist() == [1.0]


def test_rows_of_a_large_fit_are_dealt_evenly(spark, monkeypatch):
    """The scan's tasks follow the files: one large file and a small one would make every job of a fit wait for one task."""
    even = ML.TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    monkeypatch.setattr(ML, "ROWS_PER_TASK", 10)
    frame = spark.range(even * 40).repartitionByRange(2, F.greatest(F.lit(50), F.col("id")))
    sizes = [len(p) for p in ML.for_fit(frame).rdd.glom().collect()]
    assert len(sizes) == even and sum(sizes) == even * 40 and max(sizes) <= 50
    assert ML.for_fit(spark.range(40)).rdd.getNumPartitions() <= 4  # a small table keeps to few tasks


def test_a_forest_over_many_rows_grows_in_groups(spark, monkeypatch, tmpdir_path):
    """Growing all trees at once costs a counter for each row and tree, and more time a tree; in groups no tree is lost."""
    assert ML.tree_groups(40_000, 300) == [300]  # one fit, as before
    assert ML.tree_groups(14_400_000, 300) == [30] * 10 and ML.tree_groups(10 ** 12, 31) == [16, 15] and ML.tree_groups(0, 7) == [7]
    feats = b2_features(spark)
    whole, _ = ML.fit_sensor_model(feats, "random_forest", num_trees=7)
    assert whole.stages[-1].getNumTrees == 7
    monkeypatch.setattr(ML, "FOREST_COUNTERS", 3 * feats.count())
    monkeypatch.setattr(ML, "TREES_AT_ONCE", 1)
    model, _ = ML.fit_sensor_model(feats, "random_forest", num_trees=7)
    assert [p.stages[-1].getNumTrees for p in model.parts] == [3, 2, 2] and ML.boosting_rounds(model) == []
    keys = ["session_id", "window_start"]

    def scored(m):
        return [tuple(r) for r in ML.score(m, feats).select(*keys, F.round("probability", 9).alias("p"), "degraded").orderBy(*keys).collect()]

    rows, each = scored(model), [scored(p) for p in model.parts]
    for i, r in enumerate(rows):  # the mean of all trees' votes
        assert r[2] == pytest.approx((3 * each[0][i][2] + 2 * each[1][i][2] + 2 * each[2][i][2]) / 7, abs=1e-6)
    ML.save_model(model, tmpdir_path + "/forest", {"threshold": 0.3})
    again, meta = ML.load_model(spark, tmpdir_path + "/forest")
    assert scored(again) == rows and meta == {"threshold": 0.3}
