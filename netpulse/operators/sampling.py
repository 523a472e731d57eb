"""Reproducible session splits, domain balancing and downsampling.

Every random choice is "order by md5(seed ':' key)", identical in any engine
and independent of partitioning. Quotas come from small per-(group, label)
count tables; positions come from the distributed ordered index, so no label
or domain is ranked inside a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netpulse.functions.exprs import hash_order
from netpulse.operators.windows import session_labels
from netpulse.plans.ordering import ROW_KEY, rank_rows, row_index, with_row_key
from netpulse.session import materialize

DEFAULT_SEED = 42


def _check_ratio(ratio: float) -> None:
    if not 0.0 <= ratio < 1.0:
        raise ValueError(f"validation_ratio is {ratio}; it must be at least 0 and below 1")


def _quotas(sessions: DataFrame, keys: Sequence[str], ratio: float) -> DataFrame:
    """Per (keys, label): stratify flag, validation size and the label's quota.

    Validation size is ceil(r * n). Stratified when the group has >= 2 labels and
    max(1, round-half-even(r * n)) >= #labels; quotas by largest remainder
    (ties: smaller label first). A label with a single session keeps it in train.
    """
    cnt = sessions.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("_c"))
    tot = cnt.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    j = cnt.join(tot, on=list(keys)) if keys else cnt.crossJoin(tot)
    n = F.col("_n").cast("double")
    n_test = F.ceil(F.lit(float(ratio)) * n)
    usable = (F.col("_n") >= 2) & F.lit(ratio > 0.0)
    strat = (F.col("_k") >= 2) & (F.greatest(F.lit(1.0), F.bround(F.lit(float(ratio)) * n, 0)) >= F.col("_k"))
    cont = F.col("_c").cast("double") / n * n_test.cast("double")
    j = j.select(*keys, "label", "_c", usable.alias("_usable"), strat.alias("_strat"), n_test.alias("_n_test"),
                 F.floor(cont).alias("_fl"), (cont - F.floor(cont)).alias("_rem"))
    grp = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    leftover = F.col("_n_test") - F.sum("_fl").over(grp)
    rank = F.row_number().over(grp.orderBy(F.col("_rem").desc(), F.col("label").asc()))
    quota = F.col("_fl") + F.when(rank <= leftover, 1).otherwise(0)
    quota = F.when(F.col("_c") < 2, F.lit(0)).otherwise(quota)
    return j.select(*keys, "label", "_usable", "_strat", "_n_test", quota.alias("_quota"))


def session_split(features: DataFrame, validation_ratio: float = 0.2, seed: int = DEFAULT_SEED,
                  keys: Sequence[str] = ()) -> DataFrame:
    """One row per session (within ``keys``) with ``is_validation``."""
    _check_ratio(validation_ratio)
    sessions = session_labels(features, keys=(*keys, "session_id"))
    # one row per session, read by the quota table and two ordered indexes: compute once
    sessions = materialize(sessions.withColumn("_h", hash_order(seed, "session_id")))
    q = _quotas(sessions, keys, validation_ratio)
    by_label = row_index(sessions, ["_h", "session_id"], keys=[*keys, "label"], name="_i_label")
    by_all = row_index(sessions.select(*keys, "session_id", "_h"), ["_h", "session_id"], keys=list(keys), name="_i_all")
    s = by_label.join(by_all.select(*keys, "session_id", "_i_all"), on=[*keys, "session_id"])
    s = s.join(q, on=[*keys, "label"])
    validation = F.col("_usable") & F.when(
        F.col("_strat"), F.col("_i_label") < F.col("_quota")
    ).otherwise(F.col("_i_all") < F.col("_n_test"))
    return s.select(*keys, "session_id", "label", validation.alias("is_validation"))


def split_by_session(features: DataFrame, validation_ratio: float = 0.2, seed: int = DEFAULT_SEED,
                     keys: Sequence[str] = ()) -> DataFrame:
    """Mark every feature row with ``split`` = train / validation by its session's assignment."""
    sessions = session_split(features, validation_ratio, seed, keys).select(*keys, "session_id", "is_validation")
    out = features.join(sessions, on=[*keys, "session_id"], how="left")
    return out.withColumn(
        "split", F.when(F.col("is_validation"), F.lit("validation")).otherwise(F.lit("train"))
    ).drop("is_validation")


def split_by_session_per_domain(features: DataFrame, validation_ratio: float = 0.2,
                                seed: int = DEFAULT_SEED, require_validation: bool = False) -> DataFrame:
    """``split_by_session`` inside every domain."""
    out = split_by_session(features, validation_ratio, seed, keys=("domain",))
    if require_validation and validation_ratio > 0.0:
        if out.where(F.col("split") == "validation").limit(1).count() == 0:
            raise ValueError("no session of any domain is left for validation")
    return out


def balance_domains(frame: DataFrame, seed: int = DEFAULT_SEED, row_key: Sequence[str] = ("session_id", "window_start"),
                    groups: Sequence[str] = ()) -> DataFrame:
    """Undersample every domain to the smallest domain's row count (one domain: unchanged).

    ``groups`` balances several frames in one pass (e.g. every holdout fold at once). Rows count one by one: null and
    repeated keys are kept or left like others (of equal keys by content); a null domain or group is one like others.
    """
    rows = with_row_key(frame.withColumn("_h", hash_order(seed, *row_key)))
    ranked = rank_rows(rows, ["_h", *row_key], [*groups, "domain"], "_i")
    counts = ranked.groupBy(*groups, "domain").agg(F.count(F.lit(1)).alias("_rows"))  # from the checkpointed ranking
    target = counts.groupBy(*groups).agg(F.min("_rows").alias("_target"), F.count(F.lit(1)).alias("_domains"))
    target = target.select(*[F.col(g).alias(f"_t_{g}") for g in groups], "_target", "_domains")
    # one row per group (a single row without groups): bounded by the number of folds
    same = [F.col(g).eqNullSafe(F.col(f"_t_{g}")) for g in groups]
    kept = ranked.join(F.broadcast(target), on=same, how="inner") if groups else ranked.crossJoin(F.broadcast(target))
    kept = kept.where((F.col("_domains") < 2) | (F.col("_i") < F.col("_target"))).select(ROW_KEY)
    return rows.join(kept, ROW_KEY, "left_semi").select(*[F.col(f"`{c}`") for c in frame.columns])


def downsample(frame: DataFrame, max_rows: int | None, seed: int = DEFAULT_SEED,
               row_key: Sequence[str] = ("session_id", "window_start")) -> DataFrame:
    """``max_rows`` rows chosen by hash order, or all of fewer. Null and repeated keys count row by row (of equal keys
    by content), so the number is exact.

    Only the key is ranked; the rows join their rank on a number of their own, so wide rows never pass
    through the ordered index, and no task sees more than its range of keys.
    """
    if max_rows is None:
        return frame
    rows = with_row_key(frame.withColumn("_h", hash_order(seed, *row_key)))
    ranked = rank_rows(rows, ["_h", *row_key], name="_i").where(F.col("_i") < F.lit(int(max_rows)))
    return rows.join(ranked.select(ROW_KEY), ROW_KEY, "left_semi").select(*[F.col(f"`{c}`") for c in frame.columns])


def keep_sessions(frame: DataFrame, sessions: DataFrame, keys: Sequence[str] = ("session_id",)) -> DataFrame:
    """Rows whose session is in ``sessions`` (a left-semi join)."""
    return frame.join(sessions.select(*keys), on=list(keys), how="left_semi")
