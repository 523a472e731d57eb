"""Near duplicates: n-gram Jaccard join and lattice hashing against brute force."""

import math
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from netpulse.llm import lattice_dedup, ngram_join
from netpulse.llm.graph import components


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def closure(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def expected_groups(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    group = closure(range(len(rows)), links)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in group if group[j] == group[i] and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc_id))
    return sorted(out, key=str)


def groups(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df).collect()), key=str)


def test_jaccard_matches_brute_force(make, prose):
    assert groups(make(prose)) == expected_groups(prose)


def test_jaccard_threshold_is_exact(make):
    # 60 of 80 shared shingles reach 75 per cent, 59 of 80 do not
    base = [f"a{i}" for i in range(74)]
    at = base[:64] + [f"b{i}" for i in range(10)]
    rows = [(1, " ".join(base)), (2, " ".join(at)), (3, "AB c"), (4, "ab  C\n"), (5, "ab c d")]
    assert groups(make(rows)) == expected_groups(rows)
    assert {r[0]: r[2] for r in groups(make(rows))}[2] == 1
    short = base[:63] + [f"b{i}" for i in range(11)]
    assert {r[0]: r[2] for r in groups(make([(1, " ".join(base)), (2, " ".join(short))]))}[2] == 2


def test_jaccard_odd_rows(make, odd_rows):
    assert groups(make(odd_rows)) == expected_groups(odd_rows)
    assert groups(make([])) == []


def test_jaccard_large_group_of_near_copies(make):
    """All members differ from the first, and many pairs link only through others."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        ws = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            ws[rng.randrange(len(ws))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    assert groups(make(rows)) == expected_groups(rows)


def links(df):
    return sorted(((r.doc_id, r.n_links) for r in ngram_join.jaccard_links(df).collect()), key=str)


def expected_link_counts(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    return sorted(((i, sum(bool(s and u) and k != j and 100 * len(s & u) >= 75 * len(s | u) for j, (_, u) in enumerate(sets)))
                   for k, (i, s) in enumerate(sets)), key=str)


def test_links_are_counted_like_brute_force(make, prose, odd_rows):
    assert links(make(prose)) == expected_link_counts(prose)
    assert links(make(odd_rows)) == expected_link_counts(odd_rows)
    assert links(make([])) == []


def test_links_of_a_component_over_many_tiles(make, monkeypatch):
    """A chain of texts that each link with some neighbours only, of growing sizes, with copies; tiles of a few classes."""
    monkeypatch.setattr(ngram_join, "TILE", 4)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = [(i, " ".join(base[: 40 + 2 * (i // 2)])) for i in range(120)]  # two copies each
    for i in range(120, 180):
        ws = list(base[:100])
        for _ in range(rng.choice([1, 2, 3])):
            ws[rng.randrange(len(ws))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(ws)))
    rows += [(None, rows[5][1]), (7, rows[9][1]), (7, rows[9][1])]
    assert links(make(rows)) == expected_link_counts(rows)


def test_overlaps_are_intersections():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, n)).astype(np.uint64) for n in (0, 3, 50, 200, 280)]
    got = ngram_join.overlaps(sets[:3], sets[2:], width=64)
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sets[2:]] for x in sets[:3]]


def test_texts_of_a_token_are_added_up_over_blocks():
    """A passage that all texts hold, copies of a text within a block, and tokens of one text only."""
    common = " ".join(f"c{i}" for i in range(30))
    texts = [f"{common} " + " ".join(f"t{i}x{j}" for j in range(12)) for i in range(40)]
    texts[7] = texts[3]
    block = [i % 4 for i in range(40)]  # the two copies share a block
    batch = pa.RecordBatch.from_pydict({"block": pa.array(block, pa.int32()), "text": texts})
    sent = pa.Table.from_batches(list(ngram_join._send(5, 3)([batch])))
    entries = sent.group_by(["block", "part"]).aggregate([("tokens", "count")])
    assert entries.num_rows == sent.num_rows  # a block's tokens are sent once a range
    want, cut = {}, np.uint64(64 - 8 * ngram_join.COUNTED)
    held = {}
    for t, b in dict.fromkeys(zip(texts, block)):
        for token in next(ngram_join.text_sets(ngram_join.Hasher(), pa.array([t]), 5)):
            if token < ngram_join.U64(ngram_join._TOP):
                token = int(token >> cut << cut)
                want[token] = want.get(token, 0) + 1
                held.setdefault(b, set()).add(token)
    got = {}
    for part in set(sent.column("part").to_pylist()):
        answers = ngram_join._count(sent.filter(pc.equal(sent.column("part"), part)))
        for r in answers.to_pylist():
            got.setdefault(r["block"], {}).update(
                zip(ngram_join.unpack(r["tokens"], ngram_join.COUNTED).tolist(), np.frombuffer(r["texts"], np.uint32).tolist()))
    assert max(want.values()) == 39
    assert got == {b: {t: want[t] for t in tokens if want[t] > 1} for b, tokens in held.items()}


def test_prefix_shares_a_token_under_every_order():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(4, 60))
        a = rng.choice(10**6, n, replace=False)
        b = a.copy()
        b[: int(rng.integers(0, n // 7 + 1))] = rng.integers(2 * 10**6, 3 * 10**6, int(1))[0]
        sa, sb = set(a.tolist()), set(b.tolist())
        if 100 * len(sa & sb) >= 75 * len(sa | sb):
            for salt in range(3):
                order = lambda x: (x * (2 * salt + 2654435761)) % 4294967291  # noqa: E731, B023
                pa, pb = (set(sorted(s, key=order)[: ngram_join.prefix_length(len(s), 75)]) for s in (sa, sb))
                assert pa & pb


def test_components_of_a_long_path(spark):
    n = 60
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {**{i: 0 for i in range(n)}, 1000: 1000, 1001: 1000}


VEC = "vec_id long, embedding array<float>, label int, cls long, cell long, weight long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in rows], VEC)


def test_e8_decoding_is_the_nearest_point():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8)) * 1.5
    own = lattice_dedup.decode(x)
    assert np.allclose(own.sum(1) % 2, 0)
    best = ((x - own) ** 2).sum(1)
    for v in lattice_dedup.neighbours():
        assert (((x - own - v) ** 2).sum(1) >= best - 1e-9).all()


def brute_links(rows):
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) if o else None for (_, v), o in zip(rows, ok)]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9]
    return links, closure(range(len(rows)), links)


def check_links(spark, rows):
    links, group = brute_links(rows)
    number = np.bincount(np.array(links, int).ravel(), minlength=len(rows)) if links else np.zeros(len(rows), int)
    want = []
    for i, (vec_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in group if group[j] == group[i] and rows[j][0] is not None]
        low = min(ids) if ids else None
        want.append((vec_id, int(number[i]), low, vec_id is not None and vec_id == low))
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in lattice_dedup.near_duplicates(vectors(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_links_match_brute_force(spark, monkeypatch):
    """Random vectors, a large cluster over several tiles, chains at the threshold and exact copies."""
    monkeypatch.setattr(lattice_dedup, "CHUNK", 16)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(60)]
    centre = rng.normal(size=64)
    rows += [(100 + i, (centre + 0.2 * rng.normal(size=64)).tolist()) for i in range(60)]
    chain = rng.normal(size=64)
    for i in range(20):
        chain = chain + 0.4 * rng.normal(size=64)
        rows.append((200 + i, chain.tolist()))
    rows += [(300 + i, rows[0][1]) for i in range(5)] + [(400, (2 * np.array(rows[1][1])).tolist())]
    check_links(spark, rows)


def test_links_of_unusable_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0] * 8), (4, [1.0] * 7 + [None]), (5, [float("nan")] + [1.0] * 7),
            (6, [float("inf")] + [1.0] * 7), (7, [1.0] * 8), (7, [1.0] * 8), (None, [1.0] * 8), (8, [1.0] * 5), (None, None)]
    check_links(spark, rows)
    assert lattice_dedup.near_duplicates(vectors(spark, [])).collect() == []


def test_links_of_narrow_vectors_match_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = []
    for width in (8, 16, 32):
        centre = rng.normal(size=(12, width))
        rows += [(1000 * width + i, (centre[i % 12] + 0.15 * rng.normal(size=width)).tolist()) for i in range(72)]
    check_links(spark, rows)


@pytest.mark.parametrize("width", [5, 8, 16, 24, 32, 64, 100])
@pytest.mark.parametrize("cosine", [0.9001, 0.92, 0.95])
def test_recall_of_the_tables(cosine, width):
    """Share of pairs at a cosine that meet in a cell that one of them is stored in."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, width))
    x /= np.linalg.norm(x, axis=1)[:, None]
    u = rng.normal(size=(1500, width))
    u -= (u * x).sum(1)[:, None] * x
    u /= np.linalg.norm(u, axis=1)[:, None]
    y = cosine * x + np.sqrt(1 - cosine**2) * u
    lattice = lattice_dedup.Lattice(width, lattice_dedup.SCALE, lattice_dedup.PROBES)
    a, b = lattice.cells(x), lattice.cells(y)
    met = ((a == b[:, :, :1]) | (b == a[:, :, :1])).any((1, 2))
    assert met.mean() >= 0.995
