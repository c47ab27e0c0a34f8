"""The trigram model beside its definition, and how well it tells languages of texts it hasn't seen."""

import math
import random
import re
from collections import Counter


from quillspan.operators import language as L


def plain(text):
    letters = re.sub(r"[\W\d_]+", " ", (text or "").lower()).strip()
    t = f" {letters} "
    return [t[i : i + 3] for i in range(len(t) - 2)] if letters else []


ROWS = [
    (1, "La casa, la cosa y el perro", "es"), (2, "el perro de la casa", "es"), (3, "The house and the dog; 12 dogs", "en"), (4, "A dog in THE house", "en"),
    (5, "Straße über Öl", "de"), (6, None, "de"), (7, "sin idioma", None), (8, "", "en"), (9, "123 ... !", "es"), (10, "x", "de"),
]


def test_model_by_its_definition(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    got = {r["gram"]: r["weights"] for r in L.fitted(df, "doc_id", keep=8).collect()}
    counts = {}
    for _, t, lang in ROWS:
        if t is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(plain(t))
    top = {g for c in counts.values() for g in sorted(c, key=lambda g: (-c[g], g))[:8]}
    total = {k: sum(n for g, n in c.items() if g in top) for k, c in counts.items()}
    want = {g: {k: math.log((counts[k][g] + 0.5) / (total[k] + 0.5 * len(top))) for k in counts} for g in top}
    assert got.keys() == want.keys() and all(abs(got[g][k] - w) < 1e-12 for g, ws in want.items() for k, w in ws.items())
    every = [*ROWS, (11, "qqqq", "en"), (11, "la casa", "en"), (12, "the " * 3000, "en")]
    langs = ["en", "es", "de"]
    model = L.fitted(df, "doc_id", keep=8)
    rows = {r["doc_id"]: r for r in L.scores(spark.createDataFrame(every, df.schema), "doc_id", model, langs).collect()}
    assert len(rows) == 12
    for i in rows:
        grams = [g for j, t, _ in every if j == i for g in plain(t)]
        mine = [g for g in grams if g in top]
        sums = [sum(want[g][k] for g in mine) for k in langs]
        assert rows[i]["known"] == len(mine) and all(abs(rows[i][k] - s) < 1e-9 * max(1, len(mine)) for k, s in zip(langs, sums))
        assert rows[i]["detected"] == ("none" if not grams else "other" if not mine else langs[sums.index(max(sums))])
    assert rows[10]["detected"] in ("other", "de") and rows[9]["detected"] == rows[6]["detected"] == "none"


def test_bounded_sample_and_empty_tables(spark):
    df = spark.createDataFrame([(i, f"aaa{chr(97 + i % 26)}", "x") for i in range(300)], "doc_id long, text string, lang string")
    few = L.fitted(df, "doc_id", most=5)
    assert few.count() <= 2 + 5 * 2
    none = L.fitted(df.limit(0), "doc_id")
    assert none.count() == 0 and L.scores(df.limit(0), "doc_id", few, ["x"]).count() == 0
    assert {r["detected"] for r in L.scores(df, "doc_id", none, ["x"]).collect()} == {"other"}


def test_held_out_accuracy(spark):
    """Texts of invented words over overlapping alphabets."""
    rng = random.Random(8)
    parts = {"en": ["th", "er", "ing", "the", "ed"], "de": ["sch", "er", "ung", "ein", "ed"], "es": ["ción", "er", "os", "la", "ed"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 4))) for _ in range(12)), lang) for i, lang in enumerate(rng.choices(list(parts), k=300))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = df.where("doc_id % 5 = 0")
    model = L.fitted(df.where("doc_id % 5 <> 0"), "doc_id")
    got = L.accuracy(L.scores(held, "doc_id", model, sorted(parts)), held, "doc_id").collect()
    assert len(got) == 3 and all(r["share"] > 0.95 for r in got)
