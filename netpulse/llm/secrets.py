"""Secrets by multipart credential linking, in DataFrame operations only.

Strong spans (``assign``, ``access``, ``hex``) are reported by themselves. Weak candidates are
not: bare key-like strings (``key``), account or client names (``id``) and service addresses
(``endpoint``) are reported only where complementary parts occur together. Parts play the role
of an identifier, a secret or an endpoint; a weak part is linked when a part of another role,
at least one of the two being an identifier or a secret, starts within ``scope`` code points.

The link is an interval join: parts are binned by ``start / scope``, one side is dealt to its own
and both neighbouring bins, and the join on (text, bin) checks the distance. Parts of equal
texts are joined once (rows are keyed by the text's 64-bit hash), so copies add nothing. Linked parts
go back only to rows that hold weak candidates, whose copies are dealt over ``DEALT`` parts of the join.

Nulls: a null text is the empty text, without spans; ids are carried along row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netpulse.llm.common import id_text, materialize
from netpulse.llm.spans import SPAN, matches, only_if

KINDS = ("assign", "access", "hex", "key", "id", "endpoint")
STRONG = KINDS[:3]
SCOPE = 300
DEALT = 32  # parts that the copies of one text are dealt over

# Fixed base patterns.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
# Weak parts. A key right after "=" is left out where the assign pattern takes it.
KEY = (r"""(?:(?<![A-Za-z0-9+/=_.-])|(?<==)(?<!(?i:password|passwd|secret|token|api_?key)["']?\x20{0,16}=))"""
       r"[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_-])")
ACCOUNT = r"""(?i)\b(?:client_?id|user(?:name)?|login|account)["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9@._-]{3,}+)"""
ENDPOINT = r"""(?i)\b(?:https?|jdbc:[a-z]{2,12}|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[^\x20\x09-\x0D"'<>]{3,}+"""


def parts(text: Column) -> Column:
    """All strong spans and weak candidates of a text, as SPAN structs."""
    pair = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    strong_assign = F.filter(only_if(pair, matches(text, ASSIGN, "assign", 1)), lambda s: F.length(s["val"]) >= 8)
    keys = F.filter(matches(text, KEY, "key"), lambda s: s["txt"].rlike("[0-9]") & s["txt"].rlike("[A-Za-z]"))
    spans = F.concat(
        strong_assign, only_if(F.contains(text, F.lit("AKIA")), matches(text, ACCESS, "access")), matches(text, HEX, "hex"),
        keys, only_if(pair, matches(text, ACCOUNT, "id", 1)),
        only_if(F.contains(text, F.lit("://")), matches(text, ENDPOINT, "endpoint")))
    return F.transform(spans.cast(f"array<{SPAN}>"), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def role(kind: Column) -> Column:
    return F.when(kind.isin("access", "id"), "id").when(kind == "endpoint", "endpoint").otherwise("secret")


def linked(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """(key, kind, start, end) of the weak parts with a complementary part within ``scope``."""
    rows = rows.select("key", "kind", "start", "end", role(F.col("kind")).alias("role"), F.floor(F.col("start") / scope).alias("bin"))
    weak = rows.where(~F.col("kind").isin(*STRONG)).alias("w")
    near = rows.select("key", "start", "end", "role", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin")).alias("p")
    apart = (F.col("w.start") >= F.col("p.end")) | (F.col("p.start") >= F.col("w.end"))
    return weak.join(
        near, (F.col("w.key") == F.col("p.key")) & (F.col("w.bin") == F.col("p.bin")) & (F.col("w.role") != F.col("p.role"))
        & (F.abs(F.col("w.start") - F.col("p.start")) <= scope) & apart, "left_semi").select("key", "kind", "start", "end")


def in_order(spans: Column) -> Column:
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    return F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), rank[s["kind"]].alias("r"), s["end"].alias("end"), s["kind"].alias("kind"))))


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per document ``base`` (strong spans) and ``spans`` (with linked weak parts), by start, then kind."""
    found = materialize(id_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("key"), parts(F.col("text")).alias("parts")))
    weak = F.exists("parts", lambda s: ~s["kind"].isin(*STRONG)) & (F.size("parts") > 1)
    rows = found.where(weak).select("key", "parts").distinct().select("key", F.inline("parts"))
    added = linked(rows, scope).groupBy("key").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    added = added.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))))
    # rows are numbered in their written order, so copies of a text are dealt evenly
    dealt = found.where(weak).withColumn("deal", F.pmod(F.monotonically_increasing_id(), F.lit(DEALT)).cast("int"))
    with_weak = dealt.join(added, ["key", "deal"], "left").select("doc_id", "parts", "added")
    strong = F.filter("parts", lambda s: s["kind"].isin(*STRONG))
    none = F.filter("parts", lambda s: F.lit(False))
    return found.where(~weak).select("doc_id", "parts", none.alias("added")).unionByName(with_weak).select(
        "doc_id", in_order(strong).alias("base"), in_order(F.concat(strong, F.coalesce("added", none))).alias("spans"))
