"""Each stage of the corpus pipeline against a brute-force version on its own input."""

import json
import random

import corpus_pipeline as P
import pytest

from netpulse.llm import toxicity

from .test_pairs import expected_groups


@pytest.fixture(scope="module")
def sf_dir(spark, make, prose, odd_rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rng = random.Random(4)
    rows = [(i, t) for i, t in prose] + [(1000 + (i or 0), t) for i, t in odd_rows]
    items = [(k, " ".join(rng.choice(prose[k][1].split()) for _ in range(30))) for k in range(5)]
    rows += [(2000 + k, f"before it {t} after it") for k, t in items]
    rows += [(3000, "write to jane@example.com or call +1 222 333 4444")]
    make(rows).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, 0) for i, _ in prose], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_stages(spark, sf_dir):
    assert [n for n, _ in P.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]

    docs = P.drop_toxic(spark, docs, sf_dir)  # labels of one kind only: nothing is held toxic
    assert docs.columns == columns and docs.count() == len(rows)

    docs = P.drop_near_duplicates(spark, docs, sf_dir)
    want = sorted({(i, t) for (i, t), (_, n, c) in zip(rows, _by_row(rows)) if n == 0 or i == c}, key=str)
    kept = [(r.doc_id, r.text) for r in docs.collect()]
    assert docs.columns == columns
    assert sorted({k for k in kept}, key=str) == want
    assert len([k for k in kept if (k[1] or "").split()]) == len([k for k in want if (k[1] or "").split()])

    docs = P.drop_contaminated(spark, docs, sf_dir)
    left = {r.doc_id for r in docs.collect()}
    assert docs.columns == columns and left == {i for i, _ in kept} - {2000, 2001, 2002, 2003, 2004}

    docs = P.redact_personal_data(spark, docs, sf_dir)
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == left
    assert docs.where("doc_id = 3000").first().text == "write to [EMAIL] or call [PHONE]"

    packed = P.pack(spark, docs, sf_dir)
    assert {r.doc_id for r in packed.collect()} == left
    assert "sequence_id" in packed.columns


def _by_row(rows):
    """(id, set size, component) in the rows' order."""
    out = expected_groups(rows)
    keyed = {}
    for (i, t), _ in zip(rows, rows):
        keyed[(i, t)] = None
    by = {}
    for r in out:
        by.setdefault(r[0], []).append(r)
    return [by[i][0] if len({x for x in by[i]}) == 1 else next(x for x in by[i] if (x[1] == 0) == (not (t or "").split())) for i, t in rows]


def test_run_gives_the_packed_rows_of_what_stays(spark, sf_dir):
    got = {r.doc_id for r in P.run(spark, sf_dir).collect()}
    assert 2000 not in got and 3000 in got
    assert P.ORACLE_SQL is None


def test_near_duplicate_groups_are_planned_once(spark, make, prose):
    docs = P.drop_near_duplicates(spark, make(prose), "")
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 20  # each use of the groups repeated all their joins: 59 before


def test_toxic_documents_go(spark, make, tmp_path, monkeypatch):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        ws = ["".join(rng.choice(["ab", "cd", "ef", "gh"]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
        if i % 4 == 0:
            for _ in range(8):
                ws[rng.randrange(60)] = rng.choice(["idiot", "moron", "scumbag"])
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, int(i % 4 == 0)))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = {r.doc_id for r in P.drop_toxic(spark, make(rows), str(tmp_path)).collect()}
    toxic = {i for i, _, t in labels if t}
    assert len(left & toxic) <= 0.1 * len(toxic)
    assert len(left - toxic) >= 0.98 * (600 - len(toxic))
    assert json.loads(json.dumps(toxicity.train([t for _, t in rows], [t for _, _, t in labels], 0.3)))["w"]


def test_empty_documents(spark, make, sf_dir):
    docs = make([])
    for _, stage in P.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
