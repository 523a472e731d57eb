import random

from pyspark.sql import functions as F

from netpulse.llm import pii


def test_thresholds_from_all_scores(spark):
    rng = random.Random(6)
    rows = []
    for _ in range(3000):
        n, p = rng.randint(1, 5), rng.choice([rng.random(), rng.randrange(20) / 20, 1.0, 0.5 + rng.random() / 10_000])
        rows.append((p, sum(rng.random() < p for _ in range(n)), n))
    got = pii._lowest_scores(spark.createDataFrame(rows, "p double, pos long, n long").repartition(5), 0.5, 0.8, 1.1)
    for share, mine in zip((0.5, 0.8, 1.1), got, strict=True):
        fits = [t for t, _, _ in rows if sum(r[1] for r in rows if r[0] >= t) >= share * sum(r[2] for r in rows if r[0] >= t)]
        assert mine == (min(fits) if fits else None)
    assert pii._lowest_scores(spark.createDataFrame([], "p double, pos long, n long"), 0.5) == [None]


def test_every_labelled_candidate_counts(spark, monkeypatch):
    """24,000 distinct candidates, in two copies each: all are counted, once with their number, and the fit has all but a quarter."""
    y = (F.col("id") % 2).cast("int")
    f = F.array(*[F.lit(0.0)] * (pii.N_FEATURES - 2), F.col("id").cast("double"), y.cast("double"))
    cands = spark.range(24_000).select(y.alias("label"), f.alias("f"), (F.col("id") % 3 == 0).alias("loose"))
    seen, write = [], pii.materialize
    monkeypatch.setattr(pii, "materialize", lambda df: seen.append(write(df)) or seen[-1])
    model = pii.fit(cands.unionByName(cands))
    assert [tuple(r) for r in seen[0].agg(F.count(F.lit(1)), F.min("w"), F.max("w")).collect()] == [(24_000, 2, 2)]
    assert len(model.trees) == 12 and model.with_cue <= model.without and 0.5 < model.without < 1
