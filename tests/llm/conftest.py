import random

import pytest


def words(rng, n, size=400):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % size}x" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text) with copies, near copies, shared passages, nulls, blanks and a very long text."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(5, 90)) for _ in range(40)]
    passage = words(rng, 33)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(5)]
    rows += [(110 + i, base[6].replace("w1x", "other", 1) + f" end{i}") for i in range(6)]
    rows += [(120 + i, f"{base[i + 10]} {passage} {base[i + 20]}") for i in range(8)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "one"), (204, "one"), (205, "é ß 中文 text"), (206, words(rng, 6000)), (207, f"{passage} {passage}")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with a null id and columns whose names clash with what operators use inside."""
    rows = [(i, t, "x", 1, "y") for i, t in corpus] + [(None, "a row without an id", "x", 1, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n long, key string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
