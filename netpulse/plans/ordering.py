"""Order-dependent helpers that never route a whole table through one task.

``ordered_prefix`` gives exact running sums along a global order in two passes:
range-partition + sort on the order key (a checkpoint pins partition ids and
in-partition order), per-partition running sums inside each task, and a small
table of per-partition totals (one row per partition and key group) that
supplies each partition's offset. Used for row ids, tail splits, exact
ROC AUC / average precision and exact percentiles.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netpulse.session import checkpoint_dir, materialize, small

_PID = "_np_pid"


def _range(df: DataFrame, sort_cols, num_partitions: int | None) -> DataFrame:
    """Range-partition on the order key; without an explicit count AQE sizes the partitions."""
    if num_partitions:
        return df.repartitionByRange(int(num_partitions), *sort_cols)
    return df.repartitionByRange(*sort_cols)


def _cum_name(v: str) -> str:
    return f"cum_{v}"


def _local_prefix(keys: Sequence[str], values: Sequence[str]):
    """In-partition exclusive running sums; rows arrive sorted by (keys, order)."""

    def run(batches):
        last_key = None
        carry = np.zeros(len(values))
        for pdf in batches:
            if pdf.empty:
                yield pdf.assign(**{_cum_name(v): pdf[v] for v in values})
                continue
            vals = pdf[list(values)].astype("float64").fillna(0.0)
            if keys:
                key_frame = pdf[list(keys)]
                before = key_frame.shift()
                starts = ~((key_frame == before) | (key_frame.isna() & before.isna())).all(axis=1)
                gid = starts.cumsum()
                inclusive = vals.groupby(gid).cumsum()
                first_key = tuple(None if pd.isna(x) else x for x in key_frame.iloc[0])
                if last_key is not None and first_key == last_key:
                    first_group = gid == gid.iloc[0]
                    inclusive.loc[first_group] += carry
                last_key = tuple(None if pd.isna(x) else x for x in key_frame.iloc[-1])
                last_group = gid == gid.iloc[-1]
                carry = inclusive.loc[last_group].iloc[-1].to_numpy()
            else:
                inclusive = vals.cumsum() + carry
                carry = inclusive.iloc[-1].to_numpy()
            exclusive = inclusive - vals
            out = pdf.copy()
            for v in values:
                out[_cum_name(v)] = exclusive[v].to_numpy()
            yield out

    return run


def ordered_prefix(
    df: DataFrame,
    order_cols: Sequence[str | Column],
    value_cols: Sequence[str],
    keys: Sequence[str] = (),
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``cum_<v>``: the sum of ``v`` over rows of the same key group strictly
    before the row in ``order_cols`` order (an exclusive running sum, as double).

    The order must be total within a key group (add a tiebreak column otherwise).
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    sort_cols = [*[F.col(k) for k in keys], *[F.col(c) if isinstance(c, str) else c for c in order_cols]]
    ranged = (
        _range(df, sort_cols, num_partitions)
        .sortWithinPartitions(*sort_cols)
        .withColumn(_PID, F.spark_partition_id())
        .checkpoint(eager=True)
    )
    schema = T.StructType(
        [*ranged.schema.fields, *[T.StructField(_cum_name(v), T.DoubleType(), True) for v in value_cols]]
    )
    local = ranged.mapInPandas(_local_prefix(list(keys), list(value_cols)), schema)

    totals = ranged.groupBy(_PID, *keys).agg(*[F.sum(F.col(v).cast("double")).alias(f"_tot_{v}") for v in value_cols])
    before = Window.partitionBy(*keys).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        _PID, *keys, *[F.coalesce(F.sum(f"_tot_{v}").over(before), F.lit(0.0)).alias(f"_off_{v}") for v in value_cols]
    )
    # one row per range partition and key in it
    there = small(offsets.select(*[F.col(c).alias(f"_np_o_{c}") for c in (_PID, *keys)], *[f"_off_{v}" for v in value_cols]))
    match = [F.col(c).eqNullSafe(F.col(f"_np_o_{c}")) for c in (_PID, *keys)]
    joined = local.join(there, on=match, how="left")
    out_cols = [c for c in df.columns]
    return joined.select(
        *out_cols,
        *[(F.col(_cum_name(v)) + F.coalesce(F.col(f"_off_{v}"), F.lit(0.0))).alias(_cum_name(v)) for v in value_cols],
    )


def row_index(df: DataFrame, order_cols: Sequence[str | Column], keys: Sequence[str] = (), name: str = "row_index") -> DataFrame:
    """0-based position of each row in ``order_cols`` order within its key group."""
    marked = df.withColumn("_np_one", F.lit(1.0))
    out = ordered_prefix(marked, order_cols, ["_np_one"], keys)
    return out.withColumn(name, F.col("cum__np_one").cast("bigint")).drop("_np_one", "cum__np_one")


def exact_quantiles(
    df: DataFrame, value_col: str, quantiles: dict[str, float], keys: Sequence[str] = ()
) -> DataFrame:
    """Linear-interpolated exact quantiles (the ``percentile`` / numpy default rule)
    per key group, without holding a group's values in one task.

    Distinct values are counted, ranked by ``ordered_prefix``, and each quantile's
    two neighbouring ranks are looked up with a range join against a small
    table of (group, quantile, rank) targets.
    """
    counts = df.where(F.col(value_col).isNotNull()).groupBy(*keys, value_col).agg(F.count(F.lit(1)).alias("_c"))
    ranked = ordered_prefix(counts, [value_col], ["_c"], keys)
    return quantiles_from_ranked(ranked, value_col, "_c", "cum__c", quantiles, keys)


def quantiles_from_ranked(ranked: DataFrame, value_col: str, count_col: str, cum_col: str,
                          quantiles: dict[str, float], keys: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Quantiles from a table of distinct values with their counts and the count of smaller (or with
    ``descending`` larger) values: the output of one ordered pass, shareable with other statistics.
    The targets (groups x quantiles) are counted and broadcast, so the values are never shuffled by group."""
    counts = ranked.select(*keys, value_col, F.col(count_col).cast("double").alias("_c"),
                           F.col(cum_col).cast("double").alias("_cum"))
    totals = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    spec = F.array(*[F.struct(F.lit(k).alias("q_name"), F.lit(float(q)).alias("q")) for k, q in quantiles.items()])
    targets = totals.select(*keys, "_n", F.inline(spec))
    targets = targets.withColumn("_pos", F.col("q") * (F.col("_n") - 1).cast("double"))
    targets = targets.select(
        *keys,
        "q_name",
        (F.col("_n") - 1).cast("double").alias("_last"),
        (F.col("_pos") - F.floor("_pos").cast("double")).alias("_frac"),
        F.explode(
            F.array(
                F.struct(F.lit("lo").alias("side"), F.floor("_pos").cast("double").alias("rank")),
                F.struct(F.lit("hi").alias("side"), F.ceil("_pos").cast("double").alias("rank")),
            )
        ).alias("_t"),
    ).select(*keys, "q_name", "_frac", "_last", "_t.side", "_t.rank")
    if descending:
        targets = targets.withColumn("rank", F.col("_last") - F.col("rank"))
    targets = small(targets.select(*[F.col(k).alias(f"_np_t_{k}") for k in keys], "q_name", "_frac", "side", "rank"))
    cond = [F.col(k).eqNullSafe(F.col(f"_np_t_{k}")) for k in keys] + [
        F.col("_cum") <= F.col("rank"),
        F.col("rank") < F.col("_cum") + F.col("_c"),
    ]
    hit = counts.join(targets, on=cond, how="inner").select(
        *[F.col(f"_np_t_{k}").alias(k) for k in keys], "q_name", "_frac", "side", F.col(value_col).cast("double").alias("_v")
    )
    pivoted = hit.groupBy(*keys, "q_name", "_frac").agg(
        F.max(F.when(F.col("side") == "lo", F.col("_v"))).alias("_lo"),
        F.max(F.when(F.col("side") == "hi", F.col("_v"))).alias("_hi"),
    )
    value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_frac")
    return pivoted.groupBy(*keys).agg(*[F.max(F.when(F.col("q_name") == k, value)).alias(k) for k in quantiles])


_SEQ, _CARRY = "_np_seq", "_np_carry"


def _history(keys: Sequence[str], value: str, length: int, out_col: str, columns: Sequence[str]):
    """Trailing history of ``value`` (up to ``length`` earlier rows of the same key) of a partition's rows.

    Works on Arrow columns: starts of key runs and places in them as arrays, the histories of a batch as one list
    array over the values. The partition's first row brings the values that precede it in earlier partitions.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        last_key, held = None, None  # of the row before: its key, and the last values of its run (itself included)
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            key_cols = [batch.column(k) for k in keys]
            values = batch.column(value)
            new = np.zeros(n, dtype=bool)
            for c in key_cols:
                differs = pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), False)
                differs = pc.or_(differs, pc.not_equal(pc.is_null(c.slice(1)), pc.is_null(c.slice(0, n - 1))))
                new[1:] |= differs.to_numpy(zero_copy_only=False)
            first_key = [c[0].as_py() for c in key_cols]
            if held is None:
                carried = json.loads(batch.column(_CARRY)[0].as_py() or "[]")
                held = pa.array([float(v) if isinstance(v, str) else v for v in carried], values.type)  # NaN is text in JSON
            elif first_key != last_key:
                held = values.slice(0, 0)
            c = len(held)
            line = pa.concat_arrays([held, values])
            row = np.arange(n)
            start = np.maximum.accumulate(np.where(new, row, 0))
            begun = np.cumsum(new) > 0  # not in the run that earlier rows began
            take = np.minimum(np.where(begun, row - start, row + c), length)
            at = np.concatenate([[0], np.cumsum(take)])
            inside = np.arange(at[-1]) + np.repeat(c + row - take - at[:-1], take)
            history = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), line.take(pa.array(inside)))
            yield pa.RecordBatch.from_arrays([*[batch.column(x) for x in columns], history], [*columns, out_col])
            run_start = c + int(start[-1]) if begun[-1] else 0
            held = line.slice(max(run_start, len(line) - length))
            last_key = [x[n - 1].as_py() for x in key_cols]

    return run


def _carries(ranged: DataFrame, keys: Sequence[str], value: str, length: int) -> DataFrame:
    """(_np_pid, _np_carry): for every range partition whose first key began earlier, the ``length`` values before it, oldest first.

    Only the last ``length`` rows of a partition can be needed by later ones. They are numbered through all partitions (from the
    partitions' sizes: a number each on the driver, which plans a task for each anyway) and
    meet the partitions' first rows on that number in steps of ``length``, so no key's rows come together."""
    pid, pos = F.shiftright(_SEQ, 33).cast("int"), F.col(_SEQ).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(ranged.groupBy(pid.alias(_PID)).agg(F.count(F.lit(1)).alias("n")).collect())
    before = np.concatenate([[0], np.cumsum([r["n"] for r in sizes])]).tolist()
    offsets = ranged.sparkSession.createDataFrame([(r[_PID], r["n"], f) for r, f in zip(sizes, before)], f"{_PID} int, _np_n long, _np_from long")
    placed = ranged.select(pid.alias(_PID), pos.alias("_np_pos"), *keys, F.col(value).alias("_np_value")).where(
        (F.col("_np_pos") == 0) | (F.col("_np_pos") >= max(0, min((r["n"] for r in sizes), default=0) - length)))
    placed = placed.join(F.broadcast(offsets), _PID)
    tails = placed.where(F.col("_np_pos") >= F.col("_np_n") - length).select(
        (F.col("_np_from") + F.col("_np_pos")).alias("_np_at"), *[F.col(k).alias(f"_np_k_{k}") for k in keys], "_np_value")
    tails = tails.withColumn("_np_step", F.floor(F.col("_np_at") / length).cast("long"))
    firsts = placed.where((F.col("_np_pos") == 0) & (F.col("_np_from") > 0))
    steps = F.array_distinct(F.array(*[F.floor((F.col("_np_from") - d) / length).cast("long") for d in (1, length)]))
    firsts = firsts.select(_PID, "_np_from", *keys, F.explode(steps).alias("_np_step"))
    same = [F.col(k).eqNullSafe(F.col(f"_np_k_{k}")) for k in keys]
    near = [F.col("_np_at") < F.col("_np_from"), F.col("_np_at") >= F.col("_np_from") - length]
    met = firsts.join(tails.withColumnRenamed("_np_step", "_np_step2"), [F.col("_np_step") == F.col("_np_step2"), *same, *near])
    listed = met.groupBy(_PID).agg(F.sort_array(F.collect_list(F.struct("_np_at", "_np_value"))).alias("_np_list"))
    return listed.select(_PID, F.transform("_np_list", lambda x: x["_np_value"]).alias(_CARRY))


def ordered_history(
    df: DataFrame,
    order_cols: Sequence[str],
    value: str,
    length: int,
    keys: Sequence[str] = (),
    out_col: str = "history",
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``out_col``: array of up to ``length`` previous ``value``s of the same key in
    ``order_cols`` order (oldest first) — ``collect_list`` over ``rowsBetween(-length, -1)``
    without putting a whole key in one task.

    Rows are range-partitioned on (keys, order) and pinned by a checkpoint. A table with one row of at most ``length``
    values for each partition (its size is bounded by that) carries the history over the partitions'
    edges, so that one pass gives every row its whole history. Null keys are a key of their own.
    """
    return laid_out_history(lay_out(df, order_cols, keys, num_partitions), value, length, keys, out_col)


def lay_out(df: DataFrame, order_cols: Sequence[str], keys: Sequence[str] = (), num_partitions: int | None = None) -> DataFrame:
    """``df`` in range partitions sorted by (keys, order), pinned by a checkpoint, with each row's place (``_np_seq``): the input of
    ``laid_out_history``, and of other work on the same rows before it."""
    checkpoint_dir(df.sparkSession)
    sort_cols = list(dict.fromkeys([*keys, *order_cols]))
    ranged = _range(df, sort_cols, num_partitions).sortWithinPartitions(*sort_cols)
    return ranged.withColumn(_SEQ, F.monotonically_increasing_id()).checkpoint(eager=True)


def laid_out_history(ranged: DataFrame, value: str, length: int, keys: Sequence[str] = (), out_col: str = "history") -> DataFrame:
    """``ordered_history`` of rows from ``lay_out`` (with columns added or dropped since, but no rows moved)."""
    columns = [c for c in ranged.columns if c != _SEQ]
    if ranged.rdd.getNumPartitions() > 1:
        carries = F.broadcast(_carries(ranged, keys, value, length))
        first = F.col(_SEQ).bitwiseAND(F.lit((1 << 33) - 1)) == 0
        rows = ranged.withColumn(_PID, F.shiftright(_SEQ, 33).cast("int")).join(carries, _PID, "left")
        # as text: a list column that is null in all rows but one costs more to send than all others
        rows = rows.select(*columns, F.when(first, F.to_json(_CARRY, {"ignoreNullFields": "false"})).alias(_CARRY))
    else:  # no edges
        rows = ranged.select(*columns, F.lit(None).cast("string").alias(_CARRY))
    fields = [ranged.schema[c] for c in columns]
    schema = T.StructType([*fields, T.StructField(out_col, T.ArrayType(ranged.schema[value].dataType), True)])
    return rows.mapInArrow(_history(list(keys), value, length, out_col, columns), schema)


ROW_KEY, _TIE = "_np_row", "_np_tie"


def with_row_key(df: DataFrame) -> DataFrame:
    """``df`` with a number for each row (``_np_row``), fixed by writing the rows once, and a hash of the row's content
    (``_np_tie``): rows that agree in a key are told apart, and those of equal hash are (but for chance) the same row."""
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    return materialize(df.withColumns({_TIE: F.xxhash64(*plain), ROW_KEY: F.monotonically_increasing_id()}))


def rank_rows(rows: DataFrame, order_cols: Sequence[str], keys: Sequence[str] = (), name: str = "row_index") -> DataFrame:
    """(_np_row, keys, ``name``): positions of the rows of ``with_row_key`` in ``order_cols`` order within their key group, from the
    narrow columns only. Every row has one: nulls come first and are a key of their own, ties are ranked by content."""
    narrow = rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keys, *order_cols, _TIE, ROW_KEY])])
    return row_index(narrow, [*order_cols, _TIE, ROW_KEY], keys=list(keys), name=name).select(ROW_KEY, *keys, name)


def narrow_row_index(df: DataFrame, order_cols: Sequence[str], keys: Sequence[str] = (), name: str = "row_index") -> DataFrame:
    """``row_index`` computed on the (keys, order) projection only and joined back on a key of the row itself: wide rows are
    written once and take one hash shuffle on a unique key; rows with null or repeated keys keep their place."""
    rows = with_row_key(df)
    ranked = rank_rows(rows, order_cols, keys, name).select(ROW_KEY, name)
    return rows.join(ranked, ROW_KEY).select(*[F.col(f"`{c}`") for c in df.columns], name)
