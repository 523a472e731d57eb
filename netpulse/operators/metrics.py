"""Exact evaluation reports as DataFrame aggregates.

Input: a scored frame with ``label`` (0/1), ``probability`` (double) and any
grouping keys (``domain``, ``holdout``, ``algorithm`` ...). Every function takes
``keys`` and returns one row per key group (or per group and threshold), so a
per-domain or per-model report is the same single job, never a driver loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netpulse.functions.exprs import sweep_thresholds, zero_if_undefined
from netpulse.plans.ordering import exact_quantiles, ordered_prefix, quantiles_from_ranked
from netpulse.session import materialize

# Metrics averaged over domains in a macro report, the best-threshold
# subset, and the probability summary's quantiles.
MACRO_METRIC_KEYS = ("accuracy", "precision", "recall", "f1", "positive_rate", "roc_auc", "average_precision")
BEST_THRESHOLD_MACRO_KEYS = ("f1", "precision", "recall", "positive_rate", "roc_auc", "average_precision")
SUMMARY_QUANTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


def _ratios(tp: Column, fp: Column, fn: Column, tn: Column) -> list[Column]:
    n = tp + fp + fn + tn
    return [
        zero_if_undefined((tp + tn).cast("double"), n.cast("double")).alias("accuracy"),
        zero_if_undefined(tp.cast("double"), (tp + fp).cast("double")).alias("precision"),
        zero_if_undefined(tp.cast("double"), (tp + fn).cast("double")).alias("recall"),
        zero_if_undefined((2 * tp).cast("double"), (2 * tp + fp + fn).cast("double")).alias("f1"),
        zero_if_undefined((tp + fp).cast("double"), n.cast("double")).alias("positive_rate"),
    ]


def confusion_counts(scored: DataFrame, threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    pred = F.col("probability") >= F.lit(float(threshold))
    pos = F.col("label") == 1

    def count_if(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(c, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("bigint")

    return scored.groupBy(*keys).agg(
        count_if(pos & pred).alias("tp"),
        count_if(~pos & pred).alias("fp"),
        count_if(pos & ~pred).alias("fn"),
        count_if(~pos & ~pred).alias("tn"),
    )


def binary_metrics(scored: DataFrame, threshold: float, keys: Sequence[str] = (), with_ranking: bool = True) -> DataFrame:
    """Confusion matrix, accuracy, precision, recall, F1, positive rate at ``p >= threshold``
    (+ ROC AUC and average precision, NULL when a group has one class)."""
    if with_ranking:
        scored = materialize(scored)  # two consumers: confusion counts and ranking
    cm = confusion_counts(scored, threshold, keys)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    out = cm.select(*keys, F.lit(float(threshold)).alias("threshold"), *_ratios(tp, fp, fn, tn), "tn", "fp", "fn", "tp")
    if not with_ranking:
        return out
    ranking = ranking_metrics(scored, keys)
    if keys:
        return out.join(ranking, on=list(keys), how="left")
    return out.crossJoin(ranking)  # one row each side


def _score_table(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score (the only data-sized pass)."""
    is_pos = (F.col("label") == 1).cast("bigint")
    return scored.groupBy(*keys, "probability").agg(
        F.sum(is_pos).alias("pos"), F.sum(F.lit(1) - is_pos).alias("neg")
    )


def score_distribution(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct scores with positives, negatives and the counts of higher scores (one ordered pass).

    Shared by ROC AUC / average precision and by the probability percentiles.
    """
    return ordered_prefix(_score_table(scored, keys), [F.col("probability").desc()], ["pos", "neg"], keys)


def ranking_metrics(scored: DataFrame, keys: Sequence[str] = (), distribution: DataFrame | None = None) -> DataFrame:
    """Exact ROC AUC (ties count one half) and step-wise average precision.

    Per distinct score s with the running counts of higher scores, TP_s = pos_above + pos_s and
    FP_s = neg_above + neg_s: AUC = sum neg_s * (pos_above + pos_s / 2) / (P * N) and
    AP = sum pos_s * TP_s / (TP_s + FP_s) / P. Both are plain sums; no totals are joined.
    """
    pref = distribution if distribution is not None else score_distribution(scored, keys)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    tp_s, fp_s = F.col("cum_pos") + pos, F.col("cum_neg") + neg
    auc_part = neg * (F.col("cum_pos") + pos / F.lit(2.0))
    ap_part = F.when(F.col("pos") > 0, pos * tp_s / (tp_s + fp_s)).otherwise(F.lit(0.0))
    agg = pref.groupBy(*keys).agg(
        F.sum(auc_part).alias("_auc"), F.sum(ap_part).alias("_ap"), F.sum(pos).alias("_P"), F.sum(neg).alias("_N"))
    both = (F.col("_P") > 0) & (F.col("_N") > 0)
    return agg.select(
        *keys,
        F.when(both, F.col("_auc") / (F.col("_P") * F.col("_N"))).alias("roc_auc"),
        F.when(both, F.col("_ap") / F.col("_P")).alias("average_precision"),
    )


def roc_auc(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(scored, keys).select(*keys, "roc_auc")


def average_precision(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return ranking_metrics(scored, keys).select(*keys, "average_precision")


def threshold_sweep(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics at the 19 sweep thresholds in one pass over the data.

    Each row maps to the number of thresholds it reaches (0..19); the tiny
    (group, bucket) count table is then expanded against the 19 thresholds.
    """
    thresholds = sweep_thresholds()
    reached = F.aggregate(thresholds, F.lit(0), lambda acc, t: acc + F.when(F.col("probability") >= t, 1).otherwise(0))
    is_pos = (F.col("label") == 1).cast("bigint")
    buckets = scored.groupBy(*keys, reached.alias("_b")).agg(
        F.sum(is_pos).alias("_pos"), F.sum(F.lit(1) - is_pos).alias("_neg")
    )
    expanded = buckets.select(*keys, "_b", "_pos", "_neg", F.posexplode(thresholds).alias("_i", "threshold"))
    hit = F.col("_b") > F.col("_i")

    def s(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")

    cm = expanded.groupBy(*keys, "threshold").agg(
        s(F.when(hit, F.col("_pos")).otherwise(0)).alias("tp"),
        s(F.when(hit, F.col("_neg")).otherwise(0)).alias("fp"),
        s(F.when(~hit, F.col("_pos")).otherwise(0)).alias("fn"),
        s(F.when(~hit, F.col("_neg")).otherwise(0)).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return cm.select(*keys, "threshold", *_ratios(tp, fp, fn, tn), "tn", "fp", "fn", "tp")


def best_threshold(sweep: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Best sweep row per group by (F1, recall, precision, lowest threshold)."""
    cols = [c for c in sweep.columns if c not in keys]
    order = F.struct(F.col("f1"), F.col("recall"), F.col("precision"), -F.col("threshold"))
    best = sweep.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in cols])


def probability_summary(scored: DataFrame, keys: Sequence[str] = (), distribution: DataFrame | None = None) -> DataFrame:
    """min, p25, p50, p75, p95, max of the probabilities (linear interpolation); zeros if empty."""
    base = scored.groupBy(*keys).agg(F.min("probability").alias("min"), F.max("probability").alias("max"))
    if distribution is not None:
        d = distribution.withColumn("_cnt", F.col("pos") + F.col("neg")).withColumn(
            "_before", F.col("cum_pos") + F.col("cum_neg"))
        q = quantiles_from_ranked(d, "probability", "_cnt", "_before", SUMMARY_QUANTILES, keys, descending=True)
    else:
        q = exact_quantiles(scored, "probability", SUMMARY_QUANTILES, keys)
    # a global aggregate always has one row, so an empty input still yields a (zero) summary
    j = base.join(q, on=list(keys), how="left") if keys else base.join(q, how="left")
    names = ["min", *SUMMARY_QUANTILES, "max"]
    return j.select(*keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])


def regression_metrics(pred: DataFrame, actual: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean absolute error and root mean squared error."""
    e = F.col(predicted) - F.col(actual)
    return pred.groupBy(*keys).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def huber_loss(pred: DataFrame, actual: str, predicted: str, delta: float = 1.0, keys: Sequence[str] = ()) -> DataFrame:
    """Mean Huber loss: 0.5 e^2 where |e| <= delta, else delta (|e| - 0.5 delta)."""
    e = F.abs(F.col(predicted) - F.col(actual))
    loss = F.when(e <= delta, F.lit(0.5) * e * e).otherwise(F.lit(delta) * (e - F.lit(0.5 * delta)))
    return pred.groupBy(*keys).agg(F.avg(loss).alias("huber_loss"))


def metrics_by_domain(scored: DataFrame, threshold: float, keys: Sequence[str] = ("domain",)) -> DataFrame:
    """Per group: rows, class counts, metrics at ``threshold``, best sweep row and probability summary.

    The scored input feeds five aggregates; it is checkpointed once instead of recomputed.
    """
    scored = materialize(scored)
    counts = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum((F.col("label") == 0).cast("bigint")).alias("negatives"),
        F.sum((F.col("label") == 1).cast("bigint")).alias("positives"),
    )
    dist = score_distribution(scored, keys)  # one ordered pass for AUC/AP and the percentiles
    m = binary_metrics(scored, threshold, keys, with_ranking=False).join(
        ranking_metrics(scored, keys, dist), list(keys))
    best = best_threshold(threshold_sweep(scored, keys), keys)
    best = best.select(*keys, *[F.col(c).alias(f"best_{c}") for c in ("threshold", "f1", "precision", "recall", "positive_rate")])
    summary = probability_summary(scored, keys, dist)
    summary = summary.select(*keys, *[F.col(c).alias(f"prob_{c}") for c in summary.columns if c not in keys])
    return counts.join(m, list(keys)).join(best, list(keys)).join(summary, list(keys))


def macro_metrics(by_domain: DataFrame, group_keys: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean over domains of each metric (NULLs skipped), at the default
    threshold and over the best-threshold rows (with the mean best threshold)."""
    aggs = [F.avg(k).alias(k) for k in MACRO_METRIC_KEYS]
    aggs += [F.avg(f"best_{k}").alias(f"best_{k}") for k in ("f1", "precision", "recall", "positive_rate")]
    aggs += [F.avg("best_threshold").alias("best_threshold"), F.count(F.lit(1)).alias("domains")]
    return by_domain.groupBy(*group_keys).agg(*aggs)


def rank_models(report: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Order models by best F1, best recall, AP (NULL as 0), AUC (NULL as 0), all descending."""
    from pyspark.sql import Window

    order = [
        F.col("best_f1").desc(),
        F.col("best_recall").desc(),
        F.coalesce(F.col("average_precision"), F.lit(0.0)).desc(),
        F.coalesce(F.col("roc_auc"), F.lit(0.0)).desc(),
        F.col("algorithm").asc(),
    ]
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return report.withColumn("rank", F.row_number().over(w))
