"""Collocations, source divergence and substring deduplication against brute force and the registered SQL."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from netpulse.llm import collocation, divergence, queries, substrings

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n long, bucket int, part int, digest long, rank int, k1 long, spans string"


@pytest.fixture(scope="module")
def table(spark):
    """(doc_id, text, lang, source) rows with extra columns whose names clash with the operators' own."""
    return lambda rows: spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, "s") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows(odd_rows):
    rng = random.Random(11)
    words = ["The", "a", "of", "no", "İx", "é", "b-c", "d'e", "ﬁn", "x1"]
    vocabulary = words + [f"w{i}" for i in range(25)]
    out = [(i, t, lang, source) for (i, t), lang, source in zip(odd_rows, ["en", None, "de"] * 9, ["s", None, "", "t"] * 9, strict=False)]
    phrase = "the quick brown fox jumps"
    for i in range(150):
        ws = [rng.choice(vocabulary) for _ in range(rng.randrange(90))]
        for _ in range(rng.randrange(3)):
            ws.insert(rng.randrange(len(ws) + 1), phrase)
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "\x1f"]) for w in ws)
        out.append((100 + i, text, rng.choice(["en", "en", "de", None, ""]), rng.choice(["s", "t", "u", None])))
    return out + [(900, "No terms", "xx", "only"), (901, "", "xx", "other"), (902, None, "yy", None)]


# ---------------------------------------------------------------- collocations


def phrases(rows, least, top, longest=5, percent=100):
    n, f = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + m])) for m in range(1, longest + 1) for i in range(len(ws) - m + 1))
    frequent = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = []
    for (lang, p), a in frequent.items():
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        inside = any(q[0] == lang and len(q[1]) > len(p) and 100 * b >= percent * a
                     and any(q[1][i : i + len(p)] == p for i in range(len(q[1]) - len(p) + 1)) for q, b in frequent.items())
        if not inside:
            out.append((lang, " ".join(p), a, left, right, n[lang], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks = Counter()
    return [(r[0], ranks[r[0]], *r[1:]) for r in out if not ranks.update([r[0]]) and ranks[r[0]] <= top]


def found(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("least, top", [(4, 2000), (2, 30), (40, 2000)])
def test_collocations_match_brute_force(table, rows, least, top):
    assert found(collocation.collocations(table(rows), least, top=top)) == phrases(rows, least, top)


def test_collocations_absorb_by_share(table, rows):
    assert found(collocation.collocations(table(rows), 3, absorb_percent=60)) == phrases(rows, 3, 2000, percent=60)


def test_heavy_prefixes_are_split(table, rows, monkeypatch):
    """Many buckets and small blocks: heavy words, pairs and longer prefixes go by more words, and no count changes."""
    monkeypatch.setattr(collocation, "BUCKET", 1 << 12)
    monkeypatch.setattr(collocation, "BLOCK", 1 << 12)
    monkeypatch.setattr(collocation, "RANGE", 61)
    more = rows + [(2000 + i, f"the quick brown w{i % 7} a{i}. of of of of of of", "en", "s") for i in range(400)]
    docs = collocation.collocation_rows(table(more))
    size = sum(len((r[1] or "").encode()) for r in more)
    heavy = collocation.heavy_prefixes(docs, size, -(-size // (1 << 12)), 5)
    assert len(heavy[0]) > 3 and len(heavy[2]) > 0
    assert found(collocation.collocations(table(more), 3)) == phrases(more, 3, 2000)


def test_quicksort_counts_every_frequent_prefix():
    rng = np.random.default_rng(5)
    keys = np.concatenate([rng.integers(1, 3, (1, 5000)), np.minimum(rng.geometric(0.2, (3, 5000)), 40)]).astype(np.int32)
    keys[:, 4000:][1:] *= np.cumprod(rng.random((3, 1000)) < 0.7, axis=0)  # ended pieces
    weight = rng.integers(1, 4, 5000)
    want = Counter()
    for column, w in zip(keys.T.tolist(), weight.tolist(), strict=True):
        for d in range(1, 5):
            if column[d - 1]:
                want[tuple(column[:d])] += w
    got = {tuple(keys[:d, p].tolist()): n for d, ps, ns in collocation.frequent_prefixes(keys, weight, 20) for p, n in zip(ps, ns, strict=True)}
    assert got == {k: n for k, n in want.items() if n >= 20}


# ---------------------------------------------------------------- source divergence


def audit(rows, min_docs, top):
    texts = [((lang or ""), (source or ""), re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")) for _, text, lang, source in rows]
    texts = [(lang, s, [w.translate(LOWER) for w in ws]) for lang, s, ws in texts]
    out = []
    for lang in {t[0] for t in texts}:
        docs = Counter(w for x, _, ws in texts if x == lang for w in set(ws))
        kept = {w for w, n in docs.items() if n >= min_docs}
        groups = {s: Counter() for x, s, _ in texts if x == lang}
        for x, s, ws in texts:
            if x == lang:
                groups[s].update(w for w in ws if w in kept)
        whole = sum(groups.values(), Counter())

        def p(c, kept=kept):
            n = sum(c.values()) + 5 * len(kept)
            return {w: 1 + 10**9 * (c[w] + 5) // n for w in kept}

        q, ps = p(whole), {s: p(c) for s, c in groups.items()}
        for s in groups:
            pairs = [(sum(abs(ps[s][w] - ps[t][w]) for w in kept), t) for t in groups if t != s]
            terms = [(ps[s][w] - q[w], w) for w in kept if groups[s][w] and ps[s][w] > q[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda v: (-v[0], v[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def audited(df):
    return sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


@pytest.mark.parametrize("min_docs, top", [(3, 50), (1, 7), (30, 50)])
def test_divergence_matches_brute_force(table, rows, min_docs, top):
    assert audited(divergence.source_divergence(table(rows), min_docs, top)) == audit(rows, min_docs, top)


@pytest.mark.parametrize("bits", [1, 4, 9])
def test_colliding_digests_are_split(table, rows, bits):
    """Digests of a few bits name many terms each; results are those of 64 bits."""
    assert audited(divergence.source_divergence(table(rows), 3, 50, bits=bits)) == audit(rows, 3, 50)


def test_divergence_of_many_sources_in_tiles(table, rows, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES", 3)
    monkeypatch.setattr(divergence, "BLOCK", 4096)
    more = [(i, t, lang, f"{s}{j % 7}") for j, (i, t, lang, s) in enumerate(rows)]
    assert audited(divergence.source_divergence(table(more), 3, 5)) == audit(more, 3, 5)


# ---------------------------------------------------------------- substring deduplication


def without_repeats(rows, k):
    texts = [(i, re.findall("[^ \t-\r]+", t or "")) for i, t, *_ in rows]
    count = Counter(tuple(ws[j : j + k]) for _, ws in texts for j in range(len(ws) - k + 1))
    out = []
    for i, ws in texts:
        gone = {x for j in range(len(ws) - k + 1) if count[tuple(ws[j : j + k])] > 1 for x in range(j, j + k)}
        out.append((i, len(ws), len(gone), " ".join(w for x, w in enumerate(ws) if x not in gone)))
    return sorted(out, key=str)


def removed(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def sources(rows, prose):
    """Shared passages of many lengths, copies with edits, repeats within a text, runs of one word."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(90)]
    out = [(i, t) for i, t, *_ in rows] + [(1000 + i, t) for i, t in prose]
    for i in range(40):
        a = rng.randrange(60)
        ws = [f"u{rng.randrange(30)}" for _ in range(rng.randrange(40))]
        out.append((2000 + i, " ".join(ws + passage[a : a + rng.choice([9, 10, 34, 35, 36, 50])] + ws[::-1])))
    out += [(3000, " ".join(passage * 3)), (3001, "same " * 36), (3002, "Same " * 35), (3003, "other " * 34), (3004, " ".join(passage[:35])),
            (None, " ".join(passage[20:60])), (2000, " ".join(passage[:34])), (3005, " a\x0bb  ".join(passage))]
    return [(i, t, "en", "s") for i, t in out]


@pytest.mark.parametrize("k", [35, 10, 5, 1])
def test_substrings_match_brute_force(table, sources, k):
    assert removed(substrings.remove_repeats(table(sources), k)) == without_repeats(sources, k)


def test_substrings_in_small_ranges(table, sources, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 2048)
    monkeypatch.setattr(substrings, "RANGE", 37)
    assert removed(substrings.remove_repeats(table(sources), 12)) == without_repeats(sources, 12)


def test_equal_rows_repeat_each_other(table):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", "s")] * 3 + [(2, text + " end", "en", "s"), (3, "w1 w2", "en", "s")]
    assert removed(substrings.remove_repeats(table(rows))) == [(1, 40, 40, "")] * 3 + [(2, 41, 40, "end"), (3, 2, 0, "w1 w2")]


# ---------------------------------------------------------------- all three


def test_empty_tables(table):
    assert collocation.collocations(table([])).collect() == []
    assert divergence.source_divergence(table([])).collect() == []
    assert substrings.remove_repeats(table([])).collect() == []
    blank = [(1, None, None, None), (2, " .\n", "en", "s")]
    assert collocation.collocations(table(blank)).collect() == []
    assert audited(divergence.source_divergence(table(blank))) == []
    assert removed(substrings.remove_repeats(table(blank))) == [(1, 0, 0, ""), (2, 1, 0, ".")]


@pytest.mark.parametrize("name", ["op11_quicksort_collocations", "op12_source_divergence", "op13_de_bruijn_dedup"])
def test_registered_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute(queries.ORACLE[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_substring_query_digests_the_kept_text(spark, table, sources):
    got = substrings.remove_repeats(table(sources)).select("kept", F.sha2(F.col("kept").cast("binary"), 256).alias("h")).first()
    assert got.h == hashlib.sha256(got.kept.encode()).hexdigest()
