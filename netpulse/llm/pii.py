"""Personal data by candidate gradient boosting, in DataFrame operations only.

1. Generators with high recall propose spans that may overlap: the four base kinds (email, ip,
   card, phone) before their checks, and loose ones: spelled-out addresses, national phone numbers and
   IPv6-like groups. Plain numbers are proposed too, as examples of what is none.
2. Each candidate gets format features (lengths, digit and separator counts, group shapes) and context features
   (neighbouring characters, hashed words around it, what else the text holds). Neither a check's outcome nor
   a cue word is a feature: these give the weak labels.
3. Weak labels: a base span is personal data if it passes its check, and not if it fails. A loose span
   is after a cue word for personal data (``CUE``), and not after one for other numbers (``OTHER``); without either it has none.
4. Boosted trees are fitted on all distinct labelled candidates (weighted by how often they occur) but for a quarter, by hash.
5. Two thresholds are calibrated on all labelled loose spans outside the fit: loose spans after a cue are added from the lowest score at which half of the
   labelled ones at or above it are personal data, those without a cue from where ``precision`` of them are. Spans after ``OTHER``
   words and spans that overlap a base span are never added. Base spans always stay.

The trees become ordinary column expressions, so scoring needs no model transform and no join.

Nulls: a null text is the empty text, without spans. Ids are carried along only, so null
or repeated ids are kept row by row. Without candidates of one label there are no trees, and all scores are the same; without
labelled loose spans no span is added.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netpulse.llm.common import id_text, materialize
from netpulse.llm.spans import digits, let, luhn, matches, no_spans, only_if, overlaps

KINDS = ("email", "ip", "card", "phone")

# Fixed base patterns; possessive forms match the same spans as the plain ones.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Loose generators.
SPELLED = r"(?i)(?<![a-z0-9._-])[a-z0-9._-]{2,64}+[\x20]{0,2}[\[(]?(?:at|@)[\])]?[\x20]{0,2}[a-z0-9-]{2,64}+[\x20]{0,2}[\[(](?:dot|\.)[\])][\x20]{0,2}[a-z]{2,12}+"
NATIONAL = r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
GROUPS6 = r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])"
NUMBER = r"(?<![0-9])[0-9]{5,12}(?![0-9])"
# Fixed cue words, before a span.
_CUES = "e-?mail|mail|contact|phone|tel|telephone|call|dial|mobile|cell|fax|write|reach|card|visa|iban|host|server|ip|address|addr"
_OTHER = "order|invoice|part|lot|ref|reference|serial|item|sku|version|build|page|total|amount|code|batch|ticket|isbn|tracking|model|case|array|index"
CUE = rf"(?i)(?<![a-z0-9])({_CUES})(?:\s+(?:me|us|at|on|to|is|now|number|no))?\W{{0,6}}$"
OTHER = rf"(?i)(?<![a-z0-9])({_OTHER})(?:\s+(?:is|to|number|no))?\W{{0,6}}$"

CAND = ("struct<kind:string,start:int,end:int,base:boolean,loose:boolean,cue:boolean,other:boolean,label:int,f:array<double>>")
BEFORE, AFTER = 16, 8  # buckets of the words before and after a span
N_FEATURES = 13 + BEFORE + AFTER
SCORE_STEPS = 4096  # of the calibration's running counts


def _parts_ok(ip: Column) -> Column:
    """Every dot-separated part is at most 255, leading zeros aside."""
    return F.forall(F.split(ip, r"\."), lambda p: let(
        F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))


def _check(kind: str, txt: Column) -> Column:
    if kind == "ip":
        return _parts_ok(txt)
    if kind == "card":
        return let(digits(txt), lambda d: F.length(d).between(13, 19) & luhn(d))
    if kind == "phone":
        return F.length(digits(txt)).between(9, 15)
    return F.lit(True)


def _word_flags(around: Column, pattern: str, buckets: int) -> Column:
    """Which buckets the words of a text around a span fall into; cue words fall into none."""
    words = F.filter(F.split(F.lower(around), r"[^a-z\x80-\x{10FFFF}]+"), lambda w: (w != "") & ~w.rlike(rf"^({_CUES}|{_OTHER})$"))
    near = F.slice(F.reverse(words), 1, 2) if pattern == "before" else F.slice(words, 1, 1)
    hashed = F.transform(near, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)))
    return let(hashed, lambda h: F.array(*[F.array_contains(h, F.lit(k).cast("long")).cast("int").cast("double") for k in range(buckets)]))


def _features(text: Column, s: Column, before: Column, of_text: Column) -> Column:
    """Format and context features of one span, as doubles."""
    t = s["txt"]
    after = text.substr(s["end"] + 1, F.lit(24))
    d = digits(t)
    flags = [
        F.length(t), F.length(d), F.length(F.regexp_replace(t, "[^A-Za-z]", "")),
        F.length(F.regexp_replace(t, "[A-Za-z0-9]", "")), t.rlike(r"[\[(]"),
        t.rlike(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"),
        t.rlike(r"^[0-9]{4}([\x20-]?[0-9]{4}){2,3}$"), t.rlike(r"^[0-9]+$"), t.rlike(":"),
        before.rlike(r"[A-Za-z0-9_=/#]$"), after.rlike(r"^[A-Za-z0-9_/%]"),
        of_text["mail"], of_text["plus"],
    ]
    flags = F.array(*[F.coalesce(x.cast("int").cast("double"), F.lit(0.0)) for x in flags])
    return F.concat(flags, _word_flags(before, "before", BEFORE), _word_flags(after, "after", AFTER))


def candidates(text: Column) -> Column:
    """Every proposed span (CAND structs). ``base``: passes the fixed rules; ``loose``: of a loose generator; ``cue``,
    ``other``: after a cue word, after a word for other numbers; ``label``: 1, 0 or null."""
    # looked up once for each text, whatever the number of its spans
    about = F.struct(text.rlike("[0-9]").alias("digit"), F.contains(text, F.lit("@")).alias("mail"), text.rlike(r"\+[0-9]").alias("plus"))
    return let(about, lambda of_text: _proposed(text, of_text))


def _proposed(text: Column, of_text: Column) -> Column:
    has_digit = of_text["digit"]

    def propose(kind: str, pattern: str, test: Column, base: bool, label: int | None = None) -> Column:
        def one(s: Column) -> Column:
            def with_context(before: Column) -> Column:
                cue, other = before.rlike(CUE), before.rlike(OTHER)
                ok = _check(kind, s["txt"]) if base else F.lit(False)
                if base:
                    y = F.when(ok, 1).otherwise(0)
                else:
                    y = F.lit(label) if label is not None else F.when(other, 0).when(cue, 1)
                loose = F.lit(not base and label is None)
                return F.struct(s["kind"], s["start"], s["end"], ok.alias("base"), loose.alias("loose"), cue.alias("cue"), other.alias("other"),
                                y.cast("int").alias("label"), _features(text, s, before, of_text).alias("f"))

            return let(text.substr(F.greatest(s["start"] - 39, F.lit(1)), F.least(s["start"], F.lit(40))), with_context)

        return F.transform(only_if(test, matches(text, pattern, kind)), one).cast(f"array<{CAND}>")

    return F.concat(
        propose("email", EMAIL, of_text["mail"], True),
        propose("ip", IP, has_digit, True),
        propose("card", CARD, has_digit, True),
        propose("phone", PHONE, F.contains(text, F.lit("+")), True),
        propose("email", SPELLED, F.contains(text, F.lit("(")) | F.contains(text, F.lit("[")), False),
        propose("phone", NATIONAL, has_digit, False),
        propose("ip", GROUPS6, F.contains(text, F.lit(":")), False),
        propose("phone", NUMBER, has_digit, False, 0),
    )


class SpanModel:
    """Boosted trees as (weight, node) with nodes (feature, threshold, left, right) or leaf values."""

    def __init__(self, trees: list, with_cue: float = 2.0, without: float = 2.0) -> None:
        self.trees, self.with_cue, self.without = trees, with_cue, without  # 2: no score reaches it

    def score(self, f: Column) -> Column:
        def value(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            i, cut, low, high = node
            return F.when(f[i] <= cut, value(low)).otherwise(value(high))

        margin = F.lit(0.0)
        for weight, root in self.trees:
            margin = margin + F.lit(float(weight)) * value(root)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin))

    def accepted(self, cands: Column) -> Column:
        """Base spans and the loose spans that reach their threshold and overlap no base span."""
        def added(c: Column) -> Column:
            return c["loose"] & ~c["other"] & (self.score(c["f"]) >= F.when(c["cue"], self.with_cue).otherwise(self.without))

        return let(cands, lambda every: let(F.filter(every, lambda c: c["base"]), lambda base: F.concat(base, F.filter(
            every, lambda c: added(c) & ~F.exists(base, lambda b: overlaps(b, c))))))


def _node(n):
    if n.getClass().getSimpleName() == "LeafNode":
        return n.prediction()
    return (n.split().featureIndex(), n.split().threshold(), _node(n.leftChild()), _node(n.rightChild()))


def fit(cands: DataFrame, precision: float = 0.95, trees: int = 12, seed: int = 17) -> SpanModel:
    """Fit and calibrate on all distinct labelled candidates (columns of CAND)."""
    labelled = materialize(cands.where("label is not null").groupBy("label", "f", "loose").agg(F.count(F.lit(1)).alias("w")).withColumn(
        "h", F.xxhash64(F.lit(seed), "f", "loose")))
    held = F.pmod("h", F.lit(4)) == 0
    out = SpanModel([])
    if labelled.where(~held).select("label").distinct().count() == 2:
        rows = VectorAssembler(inputCols=[f"f{i}" for i in range(N_FEATURES)], outputCol="features").transform(
            labelled.where(~held).select("label", F.sqrt("w").alias("w"), *[F.col("f")[i].alias(f"f{i}") for i in range(N_FEATURES)]))
        model = GBTClassifier(labelCol="label", weightCol="w", maxIter=trees, maxDepth=3, maxBins=32, stepSize=0.3, seed=seed).fit(rows)
        out.trees = [(w, _node(t._call_java("rootNode"))) for t, w in zip(model.trees, model.treeWeights)]
    # calibration on loose spans outside the fit, or on all of them where that has none
    loose = labelled.where("loose").select("label", "w", held.alias("held"), out.score(F.col("f")).alias("p"))
    scored = materialize(loose.groupBy("held", "p").agg(F.sum(F.col("label") * F.col("w")).alias("pos"), F.sum("w").alias("n")))
    if not scored.where("held").isEmpty():
        scored = scored.where("held")
    lowest = _lowest_scores(scored, 0.5, precision)
    # a score that is summed in another order still reaches its threshold
    out.with_cue, out.without = (2.0 if p is None else math.nextafter(p, 0.0) - 1e-9 for p in lowest)
    return out


def _lowest_scores(scored: DataFrame, *shares: float) -> list[float | None]:
    """For each share the lowest score (0 to 1) at or above which at least that share of the spans is personal data, or None, over all rows of
    (p, pos, n). Counts run on within steps of the score; the counts above a step come from a table of its few steps."""
    steps = scored.groupBy("p").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n")).withColumn("step", F.floor(F.col("p") * SCORE_STEPS))
    above = Window.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = steps.groupBy("step").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))  # at most SCORE_STEPS + 1 rows
    totals = totals.select("step", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in ("pos", "n")])
    upto = Window.partitionBy("step").orderBy(F.col("p").desc())
    counts = steps.join(F.broadcast(totals), "step").select(
        "p", *[(F.col(f"{c}_above") + F.sum(c).over(upto)).alias(c) for c in ("pos", "n")])
    return list(counts.agg(*[F.min(F.when(F.col("pos") >= F.col("n") * F.lit(share), F.col("p"))) for share in shares]).first())


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document ``spans``: all accepted CAND structs by kind as listed, then start."""
    found = id_text(docs, id_col, text_col).select(
        "doc_id", candidates(F.col("text")).alias("cands"))
    found = materialize(found)
    model = fit(found.select(F.inline("cands")))
    return found.select("doc_id", in_order(model.accepted(F.col("cands"))).alias("spans"))


def in_order(spans: Column) -> Column:
    """By kind as listed, then start; a repeated added span once."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    keyed = F.transform(spans, lambda s: F.struct(
        rank[s["kind"]].alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base")))
    return F.array_distinct(F.array_sort(keyed))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with every accepted span of ``text_col`` replaced by its kind in brackets;
    other columns, clashing names included, are kept as they are. Null texts stay null, rows with null or repeated ids
    are rows like others, an empty table stays empty."""
    cands = id_text(docs, id_col, text_col).select(candidates(F.col("text")).alias("cands"))
    cands = materialize(cands.where(F.size("cands") > 0))
    model = fit(cands.select(F.inline("cands")))
    text = F.col(text_col)

    def rebuilt(spans: Column) -> Column:
        zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

        def step(acc: Column, s: Column) -> Column:
            done = acc["at"] >= s["end"]
            gap = text.substr(acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
            return F.struct(
                F.when(done, acc["out"]).otherwise(F.concat(acc["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]"))).alias("out"),
                F.greatest(acc["at"], s["end"]).alias("at"))

        by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return let(F.aggregate(by_start, zero, step), lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))

    clean = let(model.accepted(candidates(text)), lambda s: F.when(F.size(s) > 0, rebuilt(s)).otherwise(text))
    return docs.withColumn(text_col, F.when(text.isNotNull(), clean))


__all__ = ["KINDS", "candidates", "fit", "in_order", "no_spans", "personal_data", "redact"]
