"""Column-expression helpers shared by the operators.

Everything here returns a ``Column`` built from built-in functions, so the
expressions stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampNTZType

# The decision thresholds swept by the evaluation reports are
# 0.05, 0.10, ..., 0.95 built as start + i * step (19 values, i = 0..18),
# so 0.15 is the double 0.15000000000000002 exactly as the reference builds it.
SWEEP_START = 0.05
SWEEP_STEP = 0.05
SWEEP_COUNT = 19


def col_or(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip_lower(c: str | Column, lower: float) -> Column:
    """``max(c, lower)`` that keeps NULL (``greatest`` alone would turn NULL into ``lower``)."""
    c = col_or(c)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.greatest(c, F.lit(lower)))


def clip(c: str | Column, lower: float | None = None, upper: float | Column | None = None) -> Column:
    c = col_or(c)
    out = c
    if lower is not None:
        out = F.greatest(out, F.lit(lower))
    if upper is not None:
        out = F.least(out, upper if isinstance(upper, Column) else F.lit(upper))
    return F.when(c.isNull(), F.lit(None)).otherwise(out)


def zero_if_undefined(numerator: Column, denominator: Column) -> Column:
    """Ratio that is 0 when the denominator is 0 (no ANSI divide error)."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def hash_order(seed: int, *keys: str | Column) -> Column:
    """Reproducible pseudo-random order key: ``md5(seed ':' key1 ':' key2 ...)``.

    Identical in DuckDB (``md5(concat(...))``), distributed, and independent of
    partitioning, so every sample or split built on it is repeatable.
    """
    parts: list[Column] = [F.lit(str(seed))]
    for k in keys:
        parts.append(F.lit(":"))
        parts.append(F.coalesce(col_or(k).cast("string"), F.lit("")))  # a null counts as empty, as in DuckDB
    return F.md5(F.concat(*parts))


def sweep_thresholds() -> Column:
    """Array column of the 19 sweep thresholds."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(SWEEP_COUNT - 1)),
        lambda i: F.lit(SWEEP_START) + i.cast("double") * F.lit(SWEEP_STEP),
    )


def as_utc_timestamp(c: str | Column, dtype: DataType | None = None) -> Column:
    """Timestamps without zone (how parquet test data loads) become session-UTC timestamps."""
    c = col_or(c)
    if dtype is None or isinstance(dtype, TimestampNTZType):
        return c.cast("timestamp")
    return c


def round_doubles(df, places: int = 6, exclude: Iterable[str] = ()):
    """Round every double column (used at the comparison boundary only)."""
    skip = set(exclude)
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double" and f.name not in skip:
            out.append(F.round(F.col(f.name), places).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def require_columns(df, required: Iterable[str], what: str) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"{what} rows lack the columns {missing}")


def trim_all(c: Column) -> Column:
    """Without leading and trailing white space of any kind."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")
