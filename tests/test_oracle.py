"""Registered queries against their DuckDB oracle on the smallest driver tables."""

import math

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
SAMPLE = ["sensor_feature_frame", "threshold_sweep", "roc_auc", "probability_summary", "label_by_phase",
          "iat_sequences", "split_by_session_per_domain", "convert_labelled_app_flows", "choose_transport",
          "success_rate_by_context", "assign_row_ids", "metrics_by_domain", "rule_score", "write_report_values",
          "evaluate_holdouts_counts", "infer_iat_forecaster_rows"]


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan") if math.isnan(v) else (2, round(v, 5))
    if isinstance(v, bool):
        return (3, v)
    if isinstance(v, int):
        return (2, float(v))
    if hasattr(v, "isoformat"):
        return (4, v.isoformat().replace("+00:00", ""))
    if isinstance(v, (list, tuple)):
        return (5, tuple(_norm(x) for x in v))
    return (6, str(v))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "lineitem", "orders"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "packet_loss_ratio" in df.columns


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    res = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(ocols)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    oi = [ocols.index(c) for c in cols]
    exp = sorted(tuple(_norm(r[i]) for i in oi) for r in res.fetchall())
    assert got == exp
