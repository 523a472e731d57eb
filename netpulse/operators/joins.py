"""Interval labelling against experiment phases, coverage checks, folds and unions.

``label_by_phase`` is a range join written without row duplication: each run's
phases become one ordered array, and the covering phase is picked with
``filter`` + last element — the last listed phase wins where phases overlap. The table of runs is
broadcast while it is small (counted). Beyond that rows and phases meet on (run, step of time), so that a
run's rows are spread over the steps of its duration.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netpulse.operators.clean import normalize_sensor_metrics
from netpulse import session
from netpulse.session import materialize

# What a row no phase covers is labelled with.
UNLABELED = "unlabeled"
NO_SEVERITY = "none"
SEVERITIES = ("none", "mild", "moderate", "severe")
PHASE_FIELDS = ("phase_name", "start_offset_seconds", "end_offset_seconds", "label", "impairment_type", "severity")


def run_table(raw: DataFrame, phases: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One row per run: capture start (earliest row of the run), ordered phase array, run metadata."""
    starts = raw.groupBy("run_id").agg(F.min("timestamp").alias("capture_start"))
    arrays = phases.groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", *PHASE_FIELDS))).alias("phases")
    )
    table = starts.join(arrays, on="run_id", how="left")
    if runs is not None:
        table = table.join(runs, on="run_id", how="left")
    return table


STEP_SECONDS = 3600  # of the steps in which rows and phases meet when there are too many runs to broadcast


def _meet_by_run(rows: DataFrame, phases: DataFrame, runs: DataFrame | None) -> DataFrame | None:
    """Rows with their run's start and phases, by a broadcast of the counted table of runs; None if that is too large."""
    table = materialize(run_table(rows, phases, runs))
    return rows.join(F.broadcast(table), on="run_id", how="left") if table.count() <= session.BROADCAST_ROWS else None


def _meet_by_step(rows: DataFrame, phases: DataFrame, runs: DataFrame | None, step_seconds: float) -> DataFrame:
    """The same by a join on (run, step of time). The steps that have rows come from an aggregate of the rows, which is combined before
    it is shuffled; runs' starts are the least of their steps', and a step gets the phases that overlap it."""
    width = int(step_seconds * 1_000_000)
    # rows without a time have a step of their own: they keep their run's columns
    step = F.coalesce(F.expr(f"floor(unix_micros(timestamp) / {width}D)").cast("long"), F.lit(-(1 << 62)))
    rows = rows.withColumn("_step", step)
    steps = materialize(rows.groupBy("run_id", "_step").agg(F.min("timestamp").alias("capture_start")))
    about = run_table(steps.withColumnRenamed("capture_start", "timestamp"), phases, runs)
    table = steps.drop("capture_start").join(about, "run_id")
    from_start = F.col("_step").cast("double") * F.lit(float(step_seconds)) - F.unix_micros("capture_start").cast("double") / F.lit(1e6)
    margin = 1.0  # a second: rounding never decides which phases a step gets
    near = F.filter("phases", lambda p: (p["start_offset_seconds"] < from_start + F.lit(step_seconds + margin))
                    & (p["end_offset_seconds"] > from_start - F.lit(margin)))
    return rows.join(table.withColumn("phases", near), ["run_id", "_step"], "left").drop("_step")


def label_by_phase(raw: DataFrame, phases: DataFrame, runs: DataFrame | None = None, step_seconds: float = STEP_SECONDS,
                   always_steps: bool = False) -> DataFrame:
    """Label each row from the phase covering its offset from the run's first row.

    ``phases``: run_id, pos (listing order), phase_name, start/end offset seconds,
    label, impairment_type, severity. No covering phase -> ``unlabeled``, label 0,
    severity ``none``. Rows without a run or a time are covered by none. With up to ``session.BROADCAST_ROWS`` runs the rows stay where they
    are; with more, or with ``always_steps``, they meet the phases on (run, step of ``step_seconds``).
    """
    rows = raw.drop("label") if "label" in raw.columns else raw
    j = None if always_steps else _meet_by_run(rows, phases, runs)
    if j is None:
        j = _meet_by_step(rows, phases, runs, step_seconds)
    offset = (F.unix_micros("timestamp") - F.unix_micros("capture_start")).cast("double") / F.lit(1e6)
    j = j.withColumn("capture_offset_seconds", offset)
    covering = F.filter(
        F.coalesce(F.col("phases"), F.array().cast(j.schema["phases"].dataType)),
        lambda p: (F.col("capture_offset_seconds") >= p["start_offset_seconds"])
        & (F.col("capture_offset_seconds") < p["end_offset_seconds"]),
    )
    hit = F.try_element_at(covering, F.lit(-1))
    out = j.withColumn("_hit", hit)
    return out.select(
        *[c for c in rows.columns],
        *[c for c in (runs.columns if runs is not None else []) if c != "run_id"],
        F.coalesce(F.col("_hit.phase_name"), F.lit(UNLABELED)).alias("phase_name"),
        F.coalesce(F.col("_hit.impairment_type"), F.lit(UNLABELED)).alias("impairment_type"),
        F.coalesce(F.col("_hit.severity"), F.lit(NO_SEVERITY)).alias("severity"),
        "capture_offset_seconds",
        F.coalesce(F.col("_hit.label"), F.lit(0)).cast("int").alias("label"),
        F.col("_hit").isNotNull().alias("covered"),
    )


def uncovered_rows(labelled: DataFrame, limit: int = 5,
                   order: Sequence[str] = ("run_id", "session_id", "timestamp")) -> DataFrame:
    """The first ``limit`` rows no phase covers (a top-k, never a full sort)."""
    return (
        labelled.where(~F.col("covered"))
        .orderBy(*order)
        .limit(limit)
        .select(*order, "capture_offset_seconds")
    )


def build_experiment_dataset(raw: DataFrame, phases: DataFrame, runs: DataFrame | None = None,
                             strict_coverage: bool = True, passthrough: Sequence[str] = ("run_id",)) -> DataFrame:
    """All runs in one job: normalize (label not required), label by phase, check coverage."""
    prepared = normalize_sensor_metrics(raw, require_label=False, passthrough=passthrough)
    labelled = label_by_phase(prepared, phases, runs)
    if strict_coverage:
        examples = uncovered_rows(labelled).collect()  # at most 5 rows
        if examples:
            raise ValueError(
                f"the phases of the runs do not cover all rows, for example {[r.asDict() for r in examples]}"
            )
    return labelled.drop("covered")


def dataset_from_run_folders(spark: SparkSession, root: str, manifests: str = "*/manifest.json", strict_coverage: bool = True,
                             multi_line: bool = True) -> DataFrame:
    """The labelled rows of all runs under ``root``: manifests name the raw files, which are read in one scan
    (``sources.io.read_run_folders``), normalized and labelled by their run's phases."""
    from netpulse.sources.io import read_run_folders

    raw, phases, runs = read_run_folders(spark, root, manifests, multi_line)
    about = runs.select("run_id", "domain", "application", "scenario")
    return build_experiment_dataset(raw.drop(*about.columns[1:]), phases, about, strict_coverage)


def validate_phases(phases: DataFrame) -> DataFrame:
    """Rows violating the manifest rules (start >= 0, duration > 0, label >= 0, known severity)."""
    bad = (
        (F.col("start_offset_seconds") < 0)
        | (F.col("end_offset_seconds") <= F.col("start_offset_seconds"))
        | (F.col("label") < 0)
        | ~F.col("severity").isin(*SEVERITIES)
    )
    return phases.where(F.coalesce(bad, F.lit(True)))  # a missing field is a violation


def holdout_domains(frame: DataFrame) -> list[str]:
    """Distinct domain names (a bounded list: one entry per domain)."""
    return sorted(r[0] for r in frame.select("domain").distinct().collect())


def fold_table(spark: SparkSession, domains: Sequence[str]) -> DataFrame:
    """Leave-one-domain-out folds as a table (holdout, domain, role): ``eval`` for the holdout's own domain and ``train`` for the
    others. One row for each pair of domains; data rows are never copied to make it."""
    names = list(domains)
    if len(names) < 2:
        raise ValueError(f"need two domains or more to hold one out, found {len(names)}")
    if len(set(names)) != len(names):
        raise ValueError("a domain is listed twice")
    pairs = [(h, d, "eval" if h == d else "train") for h in names for d in names]
    return spark.createDataFrame(pairs, "holdout string, domain string, role string")


def fold_rows(frame: DataFrame, folds: DataFrame, holdout: str, role: str) -> DataFrame:
    """The rows of one side of one fold: a filter of ``frame`` by the domains that the fold table names."""
    names = [r["domain"] for r in folds.where((F.col("holdout") == holdout) & (F.col("role") == role)).select("domain").collect()]
    return frame.where(F.col("domain").isin(names))


def holdout_folds(frame: DataFrame, domains: Sequence[str] | None = None) -> DataFrame:
    """All folds as rows: ``frame`` joined with the fold table on the domain (each row once per holdout). Fits take
    ``fold_rows`` instead."""
    folds = fold_table(frame.sparkSession, domains if domains is not None else holdout_domains(frame))
    return frame.join(F.broadcast(folds), "domain").select(*frame.columns, "holdout", "role")  # a row for each pair of domains


def check_domains(frame: DataFrame) -> DataFrame:
    """Per-domain class counts; rows with ``ok`` false fail the fold-evaluation guard."""
    per = frame.groupBy("domain").agg(
        F.count_distinct("label").alias("classes"),
        F.sum((F.col("label") == 0).cast("bigint")).alias("negatives"),
        F.sum((F.col("label") == 1).cast("bigint")).alias("positives"),
    )
    return per.withColumn("ok", F.col("classes") >= 2)


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name; columns missing on one side become NULL."""
    if not frames:
        raise ValueError("no frame is given to unite")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
