"""Scoring, training and evaluation jobs (rule baseline + MLlib estimators)."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from netpulse.functions.exprs import clip, hash_order
from netpulse.operators import metrics as M
from netpulse.operators.windows import FEATURE_COLUMNS
from netpulse.plans.ordering import ROW_KEY, rank_rows, with_row_key
from netpulse.session import checkpoint_dir, materialize, stored

# The rule baseline flags a window at probability >= 0.7;
# trained models default to 0.15.
RULE_THRESHOLD = 0.7
MODEL_THRESHOLD = 0.15

RULE_INPUTS = ("packet_loss_ratio", "rtt_cv", "retransmission_ratio", "reset_ratio")


def rule_score(features: DataFrame, threshold: float = RULE_THRESHOLD, variation_column: str = "rtt_cv") -> DataFrame:
    """Mean of loss, RTT variation, retransmission and reset ratios, clamped to [0, 1]."""
    inputs = [F.col(c) for c in ("packet_loss_ratio", variation_column, "retransmission_ratio", "reset_ratio")]
    score = (inputs[0] + inputs[1] + inputs[2] + inputs[3]) / F.lit(4.0)
    p = clip(score, 0.0, 1.0)
    return features.withColumn("probability", p).withColumn("degraded", F.col("probability") >= F.lit(threshold))


# ------------------------------------------------------------------ MLlib estimators

# Estimator settings of the registry (tree counts are overridable).
DEFAULT_TREES = 300
LEARNING_RATE = 0.05
SUBSAMPLE = 0.9
CALIBRATION_FOLDS = 3
DEFAULT_SEED = 42
CHECKPOINT_ROUNDS = 10  # boosting writes its rows' state this often, which cuts their lineage
STOP_TOLERANCE = 0.01
ROWS_PER_TASK = 25_000  # the least that a task of a fit's many short jobs gets; larger tables are dealt evenly
TASKS_PER_CORE = 2  # of the fit of a larger table
FOREST_COUNTERS = 20_000_000  # rows times trees that a forest grows at once; other trees are grown after these
TREES_AT_ONCE = 30  # the least that a forest of many rows grows at once
BOOSTED = ("lightgbm", "lightgbm_sigmoid", "hist_gradient_boosting")
ALGORITHMS = ("lightgbm", "lightgbm_sigmoid", "hist_gradient_boosting", "random_forest", "logistic_regression")
NOT_IN_MLLIB = ("extra_trees",)

_VEC, _W, _STOP = "features_vec", "class_weight", "held_for_stopping"


def _assembler() -> VectorAssembler:
    return VectorAssembler(inputCols=list(FEATURE_COLUMNS), outputCol=_VEC, handleInvalid="keep")


def model_input(features: DataFrame) -> DataFrame:
    """Missing feature values become 0.0 at the model boundary (trees in MLlib take no NaN)."""
    return features.fillna(0.0, subset=list(FEATURE_COLUMNS))


def balanced_weights(frame: DataFrame, label: str = "label") -> DataFrame:
    """``n / (k * n_c)`` per row (the balanced class weight); the per-class table has k rows."""
    counts = frame.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = counts.agg(F.sum("_nc").alias("_n"), F.count(F.lit(1)).alias("_k"))
    w = counts.crossJoin(tot).select(label, (F.col("_n") / (F.col("_k") * F.col("_nc"))).alias(_W))
    return frame.join(F.broadcast(w), on=label, how="left")  # k rows: bounded by the class count


def build_estimator(algorithm: str, seed: int = DEFAULT_SEED, num_trees: int | None = None, early_stop: bool = False):
    """Pipeline for a registry name; unknown names raise ``ValueError``. With ``early_stop`` boosting ends, before ``num_trees``
    rounds, where the loss on rows marked ``held_for_stopping`` no longer falls by a hundredth (or by 0.0001)."""
    trees = int(num_trees or DEFAULT_TREES)
    if algorithm in NOT_IN_MLLIB:
        raise ValueError(f"Algorithm {algorithm!r} has no MLlib counterpart.")
    boosting = {"featuresCol": _VEC, "labelCol": "label", "maxIter": trees, "stepSize": LEARNING_RATE, "minInstancesPerNode": 40,
                "checkpointInterval": CHECKPOINT_ROUNDS, "seed": seed}
    if early_stop:
        boosting |= {"validationIndicatorCol": _STOP, "validationTol": STOP_TOLERANCE}
    if algorithm in ("lightgbm", "lightgbm_sigmoid"):
        est = GBTClassifier(weightCol=_W, subsamplingRate=SUBSAMPLE, featureSubsetStrategy=str(SUBSAMPLE), maxDepth=6, **boosting)
        if algorithm == "lightgbm_sigmoid":
            return SigmoidCalibrated(Pipeline(stages=[_assembler(), est]), seed=seed)
    elif algorithm == "hist_gradient_boosting":
        est = GBTClassifier(maxDepth=8, **boosting)
    elif algorithm == "random_forest":
        return Forest(_assembler(), RandomForestClassifier(featuresCol=_VEC, labelCol="label", weightCol=_W, numTrees=trees, maxDepth=12,
                                                           minInstancesPerNode=10, seed=seed))
    elif algorithm == "logistic_regression":
        scaler = StandardScaler(inputCol=_VEC, outputCol="scaled", withMean=True, withStd=True)
        lr = LogisticRegression(featuresCol="scaled", labelCol="label", weightCol=_W, maxIter=2000, tol=1e-4)
        return Pipeline(stages=[_assembler(), scaler, lr])
    else:
        raise ValueError(f"no estimator is called {algorithm!r}; there are {ALGORITHMS}")
    return Pipeline(stages=[_assembler(), est])


def positive_probability(pred: DataFrame) -> DataFrame:
    return pred.withColumn("probability", vector_to_array("probability")[1])


@dataclass
class SigmoidCalibrated:
    """Platt scaling in hash folds: each fold's base model is fitted on the other folds and a
    one-feature logistic model maps its score on the held-out fold to a probability; the
    prediction averages the fold pairs. Folds are fitted side by side, as jobs of their own. Rows are dealt one by one, whatever
    their keys; rows held for stopping take part in no fold's calibration."""

    base: Pipeline
    seed: int = DEFAULT_SEED
    folds: int = CALIBRATION_FOLDS
    pairs: list = field(default_factory=list)

    def fit(self, frame: DataFrame) -> SigmoidCalibrated:
        # dealt in hash order inside each label, so every fold has its share of both classes
        rows = with_row_key(frame.withColumn("_h", hash_order(self.seed, "session_id", "window_start")))
        rank = rank_rows(rows, ["_h", "session_id", "window_start"], ["label"], "_i")
        folds = rank.select(ROW_KEY, F.pmod("_i", F.lit(self.folds)).alias("_fold"))
        keyed = for_fit(rows.join(folds, ROW_KEY))
        held_for_stopping = F.col(_STOP) if _STOP in frame.columns else F.lit(False)

        def pair(i: int):
            base_model = self.base.fit(keyed.where((F.col("_fold") != i) | held_for_stopping))
            held = positive_probability(base_model.transform(keyed.where((F.col("_fold") == i) & ~held_for_stopping)))
            held = held.select("label", F.col("probability").alias("_raw"))
            held = VectorAssembler(inputCols=["_raw"], outputCol="_score").transform(held)
            return base_model, LogisticRegression(featuresCol="_score", labelCol="label", maxIter=100).fit(held)

        self.pairs = side_by_side(frame.sparkSession, [lambda i=i: pair(i) for i in range(self.folds)])
        return self

    def transform(self, frame: DataFrame) -> DataFrame:
        """Row-local: each fold pair adds its calibrated probability as a column; no join."""
        out = frame
        names = []
        for i, (base_model, cal) in enumerate(self.pairs):
            keep = out.columns
            s = positive_probability(base_model.transform(out)).select(*keep, F.col("probability").alias("_raw"))
            s = VectorAssembler(inputCols=["_raw"], outputCol="_score").transform(s)
            s = cal.transform(s)
            out = s.select(*keep, vector_to_array("probability")[1].alias(f"_p{i}"))
            names.append(f"_p{i}")
        p = sum((F.col(n) for n in names[1:]), F.col(names[0])) / F.lit(float(len(names)))
        return out.withColumn("probability", F.array(F.lit(1.0) - p, p)).drop(*names)


class Forest(Pipeline):
    """A random forest. MLlib draws the bootstrap of all trees at once and keeps a counter for each row and tree while they grow,
    and a pass over the rows updates the statistics of all their nodes, which many trees scatter over all of its memory. Where rows
    times trees pass ``FOREST_COUNTERS`` the trees are grown in groups of about equal size, one after the other and each with a
    seed of its own, over the same rows, whose vectors are assembled once."""

    def __init__(self, assembler: VectorAssembler, forest: RandomForestClassifier):
        super().__init__(stages=[assembler, forest])

    def fit(self, frame: DataFrame) -> PipelineModel | TreeGroups:
        assembler, forest = self.getStages()
        sizes = tree_groups(frame.count(), forest.getNumTrees())
        if len(sizes) == 1:
            return super().fit(frame)
        vectors = materialize(assembler.transform(frame).select(_VEC, forest.getLabelCol(), forest.getWeightCol()))
        groups = [forest.copy({forest.numTrees: size, forest.seed: forest.getSeed() + i}) for i, size in enumerate(sizes)]
        return TreeGroups([PipelineModel([assembler, group.fit(vectors)]) for group in groups])


def tree_groups(rows: int, trees: int) -> list[int]:
    """Sizes of the groups in which a forest's trees grow over ``rows`` rows."""
    at_once = min(trees, max(TREES_AT_ONCE, FOREST_COUNTERS // max(1, rows)))
    groups = -(-trees // at_once)
    return [trees // groups + (i < trees % groups) for i in range(groups)]


@dataclass
class TreeGroups:
    """A forest grown in groups: the mean of all trees' votes, as in one forest."""

    parts: list[PipelineModel]

    def transform(self, frame: DataFrame) -> DataFrame:
        """Row-local: each group adds its probability as a column; no join."""
        out, votes = frame, []
        for i, part in enumerate(self.parts):
            keep = out.columns
            out = positive_probability(part.transform(out)).select(*keep, F.col("probability").alias(f"_g{i}"))
            votes.append(F.col(f"_g{i}") * F.lit(float(part.stages[-1].getNumTrees)))
        p = sum(votes[1:], votes[0]) / F.lit(float(sum(part.stages[-1].getNumTrees for part in self.parts)))
        return out.withColumn("probability", F.array(F.lit(1.0) - p, p)).drop(*[f"_g{i}" for i in range(len(self.parts))])


def side_by_side(spark: SparkSession, jobs: Sequence[Callable], at_once: int = 4) -> list:
    """Results of driver functions that each submit Spark jobs, some at the same time: one fit's short jobs leave cores idle.
    A job may call this in turn: its thread has no active session, so the caller names one."""
    run = inheritable_thread_target(spark)(lambda job: job())
    with ThreadPool(min(at_once, len(jobs))) as pool:
        return pool.map(run, jobs)


def _probabilities(model, frame: DataFrame) -> DataFrame:
    out = model.transform(frame)
    if isinstance(model, (SigmoidCalibrated, TreeGroups)):
        return out.withColumn("probability", F.col("probability")[1])
    return positive_probability(out)


def _require_two_classes(frame: DataFrame) -> None:
    if frame.select("label").distinct().limit(2).count() < 2:
        raise ValueError("a fit needs rows of both classes")


def hold_for_stopping(train: DataFrame, share: float, seed: int = DEFAULT_SEED) -> DataFrame:
    """Mark the rows of about ``share`` of the sessions, by the hash of their id, with ``held_for_stopping``.
    Whole sessions are held, so that no session is on both sides; a side without both classes raises."""
    if not 0.0 < share < 1.0:
        raise ValueError(f"the share of sessions held for stopping is {share}; it must be between 0 and 1")
    marked = train.withColumn(_STOP, F.substring(hash_order(seed, F.lit("stop"), "session_id"), 1, 8) < f"{int(share * (1 << 32)):08x}")
    sides = marked.groupBy(_STOP).agg(F.count_distinct("label").alias("classes")).collect()  # two rows at most
    if sorted(r["classes"] for r in sides) != [2, 2]:
        raise ValueError("too few sessions to hold some for stopping: both sides need both classes")
    return marked


def for_fit(rows: DataFrame) -> DataFrame:
    """The rows of a fit, computed once, in no more tasks than they need: a fit runs thousands of short jobs over them. Where each
    core has more than one task's least rows, they are dealt evenly, since each job waits for its largest task: the scan's tasks
    follow the files and are uneven."""
    rows = stored(rows)
    tasks, even = max(1, -(-rows.count() // ROWS_PER_TASK)), TASKS_PER_CORE * rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(even) if tasks > even else rows.coalesce(tasks)


def boosting_rounds(model) -> list[int]:
    """Trees of each boosted model within ``model`` (one, or one a calibration fold; none for other estimators)."""
    if isinstance(model, TreeGroups):
        return []
    models = [m for m, _ in model.pairs] if isinstance(model, SigmoidCalibrated) else [model]
    return [m.stages[-1].getNumTrees for m in models if isinstance(m.stages[-1], GBTClassificationModel)]


def fit_sensor_model(train: DataFrame, algorithm: str, seed: int = DEFAULT_SEED, num_trees: int | dict | None = None,
                     stop_share: float = 0.0):
    """(model, seconds). ``num_trees``: a number, or one for some algorithms by name. With ``stop_share`` boosted models hold
    that share of the sessions back and stop when these no longer gain (``build_estimator``); by default all rounds run."""
    early_stop = stop_share > 0.0 and algorithm in BOOSTED
    est = build_estimator(algorithm, seed, num_trees.get(algorithm) if isinstance(num_trees, dict) else num_trees, early_stop)
    checkpoint_dir(train.sparkSession)  # boosting cuts its lineage there
    data = for_fit(balanced_weights(model_input(hold_for_stopping(train, stop_share, seed) if early_stop else train)))
    t0 = time.perf_counter()
    model = est.fit(data)
    return model, time.perf_counter() - t0


def score(model, features: DataFrame, threshold: float = MODEL_THRESHOLD, keep: Sequence[str] = ()) -> DataFrame:
    """probability of the positive class and ``degraded = p >= threshold``; label optional."""
    keys = [c for c in ("session_id", "domain", "window_start", "label", *keep) if c in features.columns]
    pred = _probabilities(model, model_input(features).withColumn(_W, F.lit(1.0)))
    return pred.select(*keys, "probability", (F.col("probability") >= F.lit(threshold)).alias("degraded"))


def evaluation_report(scored: DataFrame, threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    """One row per group: metrics at ``threshold``, best sweep row, probability summary."""
    return M.metrics_by_domain(scored, threshold, keys)


def train_sensor(features: DataFrame, algorithm: str = "lightgbm", validation_ratio: float = 0.2,
                 seed: int = DEFAULT_SEED, threshold: float = MODEL_THRESHOLD, num_trees: int | dict | None = None,
                 stop_share: float = 0.0):
    """Split by session, fit, evaluate on validation sessions. Returns (model, report, metadata)."""
    from netpulse.operators.sampling import split_by_session

    features = stored(features)
    _require_two_classes(features)
    split = stored(split_by_session(features, validation_ratio, seed))
    train = split.where(F.col("split") == "train").drop("split")
    valid = split.where(F.col("split") == "validation").drop("split")
    model, seconds = fit_sensor_model(train, algorithm, seed, num_trees, stop_share)
    scored = score(model, valid, threshold)
    report = evaluation_report(scored.withColumn("scope", F.lit("validation")), threshold, ["scope"])
    meta = {"algorithm": algorithm, "threshold": threshold, "fit_seconds": seconds, "seed": seed, "rounds": boosting_rounds(model),
            "validation_ratio": validation_ratio, "feature_columns": list(FEATURE_COLUMNS),
            **_report_counts(train, valid)}
    return model, report, meta


def infer_sensor(model, features: DataFrame, threshold: float | None = None, metadata: dict | None = None) -> DataFrame:
    t = threshold if threshold is not None else (metadata or {}).get("threshold", MODEL_THRESHOLD)
    return score(model, features, t)


def train_sensor_multidomain(features: DataFrame, algorithm: str = "lightgbm", validation_ratio: float = 0.2,
                             seed: int = DEFAULT_SEED, threshold: float = MODEL_THRESHOLD, balance: bool = True,
                             num_trees: int | None = None):
    """Per-domain session split, optional domain balancing, one fit; pooled + per-domain + macro report."""
    from netpulse.operators.sampling import balance_domains, split_by_session_per_domain

    features = stored(features)
    _require_two_classes(features)
    split = stored(split_by_session_per_domain(features, validation_ratio, seed))
    train = split.where(F.col("split") == "train").drop("split")
    valid = split.where(F.col("split") == "validation").drop("split")
    fit_rows = stored(balance_domains(train, seed)) if balance else train
    model, seconds = fit_sensor_model(fit_rows, algorithm, seed, num_trees)
    scored = materialize(score(model, valid, threshold))
    pooled = evaluation_report(scored.withColumn("domain", F.lit("__pooled__")), threshold, ["domain"])
    per_domain = evaluation_report(scored, threshold, ["domain"])
    macro = M.macro_metrics(per_domain).withColumn("domain", F.lit("__macro__"))
    report = pooled.unionByName(per_domain).unionByName(macro, allowMissingColumns=True)
    by_domain = {r["domain"]: r["n"] for r in train.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    after = {r["domain"]: r["n"] for r in fit_rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    meta = {"algorithm": algorithm, "threshold": threshold, "fit_seconds": seconds, "balanced": balance,
            "feature_columns": list(FEATURE_COLUMNS), "rows_by_domain": by_domain, "fit_rows_by_domain": after,
            **_report_counts(fit_rows, valid)}
    return model, report, meta


def _report_counts(train: DataFrame, evaluated: DataFrame) -> dict[str, int]:
    """Row and class counts that go with a report."""
    out = {}
    for name, frame in (("train", train), ("eval", evaluated)):
        r = frame.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("label") == 1).cast("long")).alias("pos")).first()
        out |= {f"{name}_rows": int(r["n"]), f"{name}_positive": int(r["pos"] or 0)}
    return out


def _with_counts(report: DataFrame, counts: dict[str, int]) -> DataFrame:
    return report.withColumns({k: F.lit(v).cast("long") for k, v in counts.items()})


def evaluate_transfer(source: DataFrame, target: DataFrame, algorithm: str = "lightgbm", seed: int = DEFAULT_SEED,
                      threshold: float = MODEL_THRESHOLD, max_train_rows: int | None = None, num_trees: int | None = None):
    """Fit on dataset A, evaluate on all of dataset B. ``max_train_rows`` bounds the labelled rows of the
    fit; evaluation rows are never cut."""
    from netpulse.operators.sampling import downsample

    a = stored(downsample(source, max_train_rows, seed))
    _require_two_classes(a)
    model, seconds = fit_sensor_model(a, algorithm, seed, num_trees)
    scored = stored(score(model, target, threshold).withColumn("scope", F.lit("target")))
    report = evaluation_report(scored, threshold, ["scope"]).withColumn("fit_seconds", F.lit(seconds))
    return _with_counts(report, _report_counts(a, scored))


def evaluate_holdouts(features: DataFrame, algorithm: str = "logistic_regression", seed: int = DEFAULT_SEED,
                      threshold: float = MODEL_THRESHOLD, balance: bool = True, num_trees: int | None = None):
    """Leave-one-domain-out: one fit per holdout domain (each a distributed fit, up to four at the same time, which ``fit_seconds``
    includes), predictions stacked, all metrics in one grouped aggregate keyed by holdout; macro rows at the default and the best threshold.

    Rows are not copied per holdout. Each row is ranked once in hash order inside its domain; the fold of
    holdout h trains on the rows of the other domains whose rank is below their smallest row count.
    """
    from netpulse.operators.joins import check_domains, fold_rows, fold_table, holdout_domains

    names = holdout_domains(features)
    folds = fold_table(features.sparkSession, names)
    bad = check_domains(features).where(~F.col("ok")).limit(1).collect()
    if bad:
        raise ValueError(f"Domain {bad[0]['domain']} lacks one of the classes")
    key = ["session_id", "window_start"]
    keyed = with_row_key(features.withColumn("_h", hash_order(seed, *key)))
    ranked = rank_rows(keyed, ["_h", *key], ["domain"], "_i")
    feats = materialize(keyed.join(ranked.select(ROW_KEY, "_i"), ROW_KEY).select(*features.columns, "_i"))
    rows = {r["domain"]: r["n"] for r in feats.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}

    def one(d: str):
        train = fold_rows(feats, folds, d, "train")
        if balance and len(names) > 2:
            train = train.where(F.col("_i") < min(n for k, n in rows.items() if k != d))
        train = train.drop("_i")
        held = fold_rows(feats, folds, d, "eval").drop("_i")
        model, seconds = fit_sensor_model(train, algorithm, seed, num_trees)
        counts = _report_counts(train, held)
        return score(model, held, threshold).withColumn("holdout", F.lit(d)), (d, float(seconds), *[counts[k] for k in _COUNTS])

    preds, extra = (list(x) for x in zip(*side_by_side(features.sparkSession, [lambda d=d: one(d) for d in names]), strict=True))
    stacked = preds[0]
    for p in preds[1:]:
        stacked = stacked.unionByName(p)
    per = evaluation_report(stacked, threshold, ["holdout"])
    macro = M.macro_metrics(per).withColumn("holdout", F.lit("__macro__"))
    about = per.sparkSession.createDataFrame(extra, "holdout string, fit_seconds double, " + ", ".join(f"{c} long" for c in _COUNTS))
    return per.unionByName(macro, allowMissingColumns=True).join(about, "holdout", "left")


_COUNTS = ("train_rows", "train_positive", "eval_rows", "eval_positive")


def compare_models(features: DataFrame, algorithms: Sequence[str] = ALGORITHMS, validation_ratio: float = 0.2,
                   seed: int = DEFAULT_SEED, threshold: float = MODEL_THRESHOLD, max_train_rows: int | None = None,
                   num_trees: int | dict | None = None, stop_share: float = 0.0) -> DataFrame:
    """One split, N estimators fitted side by side (up to four at the same time, which ``fit_seconds`` includes); stacked predictions,
    metrics grouped by algorithm, ranked. ``max_train_rows`` bounds the train side of the split only."""
    from netpulse.operators.sampling import downsample, split_by_session

    features = stored(features)
    _require_two_classes(features)
    split = stored(split_by_session(features, validation_ratio, seed))
    train = downsample(split.where(F.col("split") == "train").drop("split"), max_train_rows, seed)
    valid = split.where(F.col("split") == "validation").drop("split")
    fits = side_by_side(features.sparkSession, [lambda a=a: fit_sensor_model(train, a, seed, num_trees, stop_share) for a in algorithms])
    secs = [(a, float(seconds)) for a, (_, seconds) in zip(algorithms, fits, strict=True)]
    preds = [score(model, valid, threshold).withColumn("algorithm", F.lit(a)) for a, (model, _) in zip(algorithms, fits, strict=True)]
    stacked = preds[0]
    for p in preds[1:]:
        stacked = stacked.unionByName(p)
    report = evaluation_report(stacked, threshold, ["algorithm"])
    fit = report.sparkSession.createDataFrame(secs, "algorithm string, fit_seconds double")
    return M.rank_models(_with_counts(report.join(fit, "algorithm"), _report_counts(train, valid)))


# ------------------------------------------------------------------ next-gap forecaster


def train_iat_forecaster(iat: DataFrame, sequence_length: int = 20, validation_ratio: float = 0.2,
                         max_iter: int = 100, reg_param: float = 0.0):
    """Sequences -> tail split -> Huber-loss linear regression on the history vector.

    Returns (model, report, metadata with sequence length, mean, std). Replaces the
    recurrent network with an MLlib regressor under the same loss. Like epochs, the optimizer's iterations are judged on the validation
    samples: fits of an eighth, a quarter, a half and all of ``max_iter`` run side by side, and the one of the lowest
    validation Huber loss is kept (of equal ones the shortest; without validation samples the longest).
    """
    from netpulse.operators.sequences import iat_sequences, iat_stats, tail_split

    stats = iat_stats(iat).first()  # one row
    seq = iat_sequences(iat, sequence_length, require_samples=True)
    split = materialize(tail_split(seq, validation_ratio)).withColumn("x", array_to_vector("inputs"))
    train = split.where(F.col("split") == "train")
    if train.limit(1).count() == 0:
        raise ValueError("no sample is left to train the forecaster on")
    validation = split.where(F.col("split") == "validation")
    steps = sorted({max(1, max_iter // d) for d in (8, 4, 2, 1)})

    def fit(n: int):
        lr = LinearRegression(featuresCol="x", labelCol="target", loss="huber", maxIter=n, regParam=reg_param)
        model = lr.fit(train)
        return model, M.huber_loss(model.transform(validation), "target", "prediction").first()["huber_loss"]

    fits = side_by_side(iat.sparkSession, [lambda n=n: fit(n) for n in steps])
    losses = {n: loss for n, (_, loss) in zip(steps, fits, strict=True)}
    chosen = min(steps, key=lambda n: losses[n]) if None not in losses.values() else steps[-1]
    model = fits[steps.index(chosen)][0]
    valid = model.transform(validation).withColumn("predicted_iat_ms", F.col("prediction") * F.col("std") + F.col("mean"))
    report = M.regression_metrics(valid, "actual_iat_ms", "predicted_iat_ms").crossJoin(
        M.huber_loss(valid, "target", "prediction"))
    meta = {"sequence_length": sequence_length, "mean": stats["mean"], "std": stats["std"], "iterations": chosen,
            "validation_losses": {str(n): v for n, v in losses.items()}}
    return model, report, meta


def infer_iat_forecaster(model, iat: DataFrame, metadata: dict) -> DataFrame:
    """Predict next gaps with stored normalization; de-normalize and report the absolute error."""
    from netpulse.operators.sequences import iat_inference_frame

    frame = iat_inference_frame(iat, metadata["mean"], metadata["std"], metadata["sequence_length"])
    pred = model.transform(frame.withColumn("x", array_to_vector("inputs")))
    pred = pred.withColumn("predicted_iat_ms", F.col("prediction") * F.col("std") + F.col("mean"))
    return pred.select("trace_id", "target_packet_index", "actual_iat_ms", "predicted_iat_ms",
                       F.abs(F.col("predicted_iat_ms") - F.col("actual_iat_ms")).alias("abs_error_ms"))


def _metadata(spark: SparkSession, path: str, value: dict | None = None) -> dict:
    """Write (or read) the small metadata JSON beside a model, through Spark so that any store works."""
    if value is not None:
        spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata_json")
        return value
    return json.loads(spark.read.text(f"{path}/metadata_json").first()["value"])


def save_model(model, path: str, metadata: dict | None = None) -> None:
    """Save any model of this module with its metadata: a pipeline, a calibrated model, a forest grown in groups or the forecaster."""
    path = path.rstrip("/")
    if isinstance(model, SigmoidCalibrated):
        kind = {"kind": "sigmoid", "seed": model.seed, "folds": model.folds}
        for i, (base, curve) in enumerate(model.pairs):
            base.write().overwrite().save(f"{path}/base{i}")
            curve.write().overwrite().save(f"{path}/curve{i}")
    elif isinstance(model, TreeGroups):
        kind = {"kind": "forest", "groups": len(model.parts)}
        for i, part in enumerate(model.parts):
            part.write().overwrite().save(f"{path}/group{i}")
    elif isinstance(model, (PipelineModel, LinearRegressionModel)):
        kind = {"kind": "pipeline" if isinstance(model, PipelineModel) else "forecaster"}
        model.write().overwrite().save(f"{path}/model")
    else:
        raise ValueError(f"cannot save a {type(model).__name__}")
    _metadata(SparkSession.getActiveSession(), path, {**(metadata or {}), "_model": kind})


def load_model(spark: SparkSession, path: str) -> tuple[object, dict]:
    """(model, metadata) as saved by ``save_model``."""
    path = path.rstrip("/")
    meta = _metadata(spark, path)
    kind = meta.pop("_model")
    if kind["kind"] == "sigmoid":
        pairs = [(PipelineModel.load(f"{path}/base{i}"), LogisticRegressionModel.load(f"{path}/curve{i}")) for i in range(kind["folds"])]
        return SigmoidCalibrated(None, kind["seed"], kind["folds"], pairs), meta
    if kind["kind"] == "forest":
        return TreeGroups([PipelineModel.load(f"{path}/group{i}") for i in range(kind["groups"])]), meta
    return (PipelineModel if kind["kind"] == "pipeline" else LinearRegressionModel).load(f"{path}/model"), meta
