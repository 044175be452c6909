import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """(doc_id, text) rows with the other columns, one of them null, and two clashing extra columns."""

    def make(rows):
        out = spark.createDataFrame([(i, t, "en" if i is None or i % 2 else None, None, None if t is None else len(t)) for i, t in rows], DOCS)
        return out.selectExpr("*", "1 as n", "'x' as keep").repartition(3)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Random prose with exact copies, near copies and shared passages."""
    rng = random.Random(5)
    words = ["w" + "".join(rng.choices("abcdefgh", k=rng.randint(1, 4))) for _ in range(300)]
    passage = " ".join(rng.choices(words, k=30))
    rows = []
    for i in range(120):
        kind = i % 6
        if kind == 1 and rows:
            text = rows[rng.randrange(len(rows))][1]
        elif kind == 2 and rows:
            w = (rows[rng.randrange(len(rows))][1] or "x y z").split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(words)
            text = " ".join(w)
        elif kind == 3:
            text = " ".join(rng.choices(words, k=rng.randint(1, 60))) + " " + passage
        else:
            text = " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 20, 90, 200])))
        rows.append((i, text))
    return rows + [(200, None), (201, ""), (202, "  \n\t "), (203, "one"), (204, "One"), (205, "two words")]
