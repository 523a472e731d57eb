import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
          "score double, key long, block int, label int, n long, cls long, kind string, text_key long")


def table(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, 7, 1, 1, 2, 3, "k", 4) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: table(spark, rows)


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, a null id, repeated rows, blanks only, one word, a very long text."""
    rng = random.Random(1)
    words = [f"w{rng.randrange(500)}" for _ in range(30_000)]
    same = "one two three four five six seven eight nine ten"
    return [(1, same), (2, None), (3, ""), (4, " \t\n "), (5, "word"), (None, same), (6, same), (6, same),
            (7, " ".join(words)), (8, "x" * 50_000), (9, "é" * 300 + " İ ﬁ \U0001f600 end."), (None, None)]


@pytest.fixture(scope="session")
def prose():
    """Seeded documents with exact copies, near copies in chains, and shared passages."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 7)))
    vocabulary = [word() for _ in range(400)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = []
    for i in range(120):
        ws = [rng.choice(vocabulary) for _ in range(rng.randint(3, 160))]
        kind = i % 6
        if kind == 1 and rows:  # an exact copy
            ws = rows[rng.randrange(len(rows))][1].split()
        elif kind in (2, 3) and rows:  # a near copy of the document before: chains of similar texts
            ws = rows[-1][1].split()
            for _ in range(max(1, len(ws) // 60)):
                ws[rng.randrange(len(ws))] = word()
        elif kind == 4:
            ws = ws[:20] + passage.split() + ws[20:40]
        rows.append((i, " ".join(ws)))
    return rows
