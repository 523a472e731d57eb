"""Regular-expression spans as native array columns, with code-point positions.

Patterns avoid nested backtracking (possessive groups), so long texts stay linear and cannot
overflow the regex engine's stack. Only texts that a pattern splits are searched a second time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<kind:string,start:int,end:int,txt:string,val:string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def no_spans(kind: str = SPAN) -> Column:
    return F.array().cast(f"array<{kind}>")


def matches(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as SPAN structs; ``val`` holds ``group``."""

    def place(gaps: Column, found: Column, vals: Column) -> Column:
        ends = F.aggregate(
            F.arrays_zip(F.slice(F.transform(gaps, F.length), 1, F.size(found)).alias("g"),
                         F.transform(found, F.length).alias("m")),
            F.array().cast("array<int>"),
            lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + x["g"] + x["m"])),
        )
        return F.transform(
            F.arrays_zip(ends.alias("e"), found.alias("t"), vals.alias("v")),
            lambda x: F.struct(F.lit(kind).alias("kind"), (x["e"] - F.length(x["t"])).alias("start"),
                               x["e"].alias("end"), x["t"].alias("txt"), x["v"].alias("val")),
        )

    every = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    vals = (lambda m: m) if group == 0 else (lambda m: F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    return let(
        F.split(text, pattern, -1),
        lambda gaps: F.when(F.size(gaps) > 1, let(every, lambda m: place(gaps, m, vals(m)))).otherwise(no_spans()),
    )


def only_if(test: Column, spans: Column) -> Column:
    return F.when(test, spans).otherwise(no_spans())


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def total(d: Column) -> Column:
        n = F.length(d)

        def add(acc: Column, i: Column) -> Column:
            x = d.substr(n - i + 1, F.lit(1)).cast("int")
            twice = F.when(x > 4, 2 * x - 9).otherwise(2 * x)
            return acc + F.when(i % 2 == 0, twice).otherwise(x)

        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)

    return F.when(F.length(number) > 0, total(number) % 10 == 0).otherwise(False)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined in the array's order."""
    return F.concat_ws(",", F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])
