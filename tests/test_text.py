import random

import pytest
from pyspark.sql import functions as F

from quillspan.functions import stats, udfs
from quillspan.functions import text as T
from quillspan.functions import vectors as V


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "text, number",
    [("1,234", 1234), ("1.234,50", 1234.5), ("1,5", 1.5), ("12-7", -7), ("1,234,567.89", 1234567.89), ("it is 7 or 8.", 8), ("none", None), (None, None), ("", None), ("１２", 12), ("x 0.12", 0.12), ("x 0.125", 125)],
)
def test_last_number(spark, text, number):
    assert one(spark, T.last_number, text) == number


@pytest.mark.parametrize("text, letter", [("A or B.", "B"), ("ABC", None), ("(D)", "D"), ("E", None), (None, None), ("xA A", "A")])
def test_last_letter(spark, text, letter):
    assert one(spark, T.last_letter, text) == letter


@pytest.mark.parametrize(
    "text, letter",
    [
        ("Answer: A then Answer: none", None), ("**Answer:** C", "C"), ("Respuesta: $\\boxed{E}$", "E"), ("答案：　D", "D"), ("no marker A", None), (None, None),
        ("Answer: B\nmore text", "B"), ("## ANSWER: (J)", "J"), ("Answer: Because", None), ("Answer: A\nRespuesta: B", "B"),
    ],
)
def test_parse_letter(spark, text, letter):
    assert one(spark, T.parse_letter, text) == letter


def test_blank_chars_norm(spark):
    assert one(spark, T.is_blank, "　 \n") and one(spark, T.is_blank, None) and not one(spark, T.is_blank, " x ")
    assert one(spark, T.chars, "é中") == 2 and one(spark, T.chars, None) == 0
    assert one(spark, T.normalised, "  Ein, Fall_1! Ü\n") == "ein fall_1 ü"
    assert one(spark, lambda c: T.ngrams(c, 2), ["a", "b", "a", "b"], "array<string>") == ["a b", "b a"]
    assert one(spark, lambda c: T.ngrams(c, 13), ["a"] * 12, "array<string>") == []


def test_messages(spark):
    kind = "array<struct<role:string,content:string>>"
    ok = [("user", "q"), ("assistant", "r</think>a")]
    assert one(spark, T.one_split, ok, kind)
    for bad in ([*ok, ("user", "x")], [("user", "</think>"), *ok], [("user", "q")], []):
        assert not one(spark, T.one_split, bad, kind)
    assert one(spark, T.user_turns, [("user", "a"), ("assistant", "b"), ("user", "c")], kind) == "a\nc"
    df = spark.createDataFrame([(ok, [("user", "p"), ("assistant", "plan</think>z")])], f"a {kind}, b {kind}")
    assert df.select(T.mixed_arm("a", "b")).first()[0] == [("user", "q"), ("assistant", "plan</think>a")]


def test_options(spark):
    df = spark.createDataFrame([(["x", None, " ", "y"], 3)], "o array<string>, i int")
    assert df.select(T.compacted("o"), T.compacted_gold("o", F.col("i")), T.compacted_gold("o", F.lit(1))).first()[:] == (["x", "y"], "B", None)


def plainly(t, span=60, repeats=5):
    """Every stretch, its places taken greedily from the left."""
    for s in {t[i : i + span] for i in range(len(t) - span + 1)}:
        n, at = 0, t.find(s)
        while at >= 0:
            n, at = n + 1, t.find(s, at + span)
        if n >= repeats:
            return True
    return False


def test_looping(spark):
    assert udfs.loops(["a" * 300, "a" * 299, "ab" * 30, None, ""]).tolist() == [True, False, False, False, False]
    rng = random.Random(4)
    unit = "".join(rng.choice("abcd é中😀") for _ in range(61))
    texts = ["".join(rng.choice(["ab", "c ", "中"]) for _ in range(rng.randint(0, 400))) for _ in range(40)]
    texts += [" ".join([unit] * n) for n in range(1, 8)] + [unit[:n] * 9 for n in (3, 7, 30, 33, 59, 60)] + [("x" * 70 + unit) * 4 + "y" * rng.randint(0, 90) for _ in range(5)]
    for span, repeats in ((60, 5), (12, 3), (7, 2), (1, 4), (64, 2)):
        assert udfs.loops(texts, span, repeats).tolist() == [plainly(t, span, repeats) for t in texts]
    df = spark.createDataFrame([(1, "a" * 300), (2, None), (3, "b" * 299)], "id int, t string")
    assert [r[1] for r in df.select("id", udfs.looping(F.col("t"))).orderBy("id").collect()] == [True, False, False]
    assert one(spark, udfs.nfkc, "ﬁ") == "fi" and one(spark, udfs.nfkc, None) is None and one(spark, udfs.norm, "  Ｅin, ﬁ-Fall_1! Ü\n") == "ein fi fall_1 ü"


def test_gram_hashes():
    rng = random.Random(2)
    texts = ["", "one", "a b c", *(" ".join(rng.choice(["ab", "ba", "a", "é", "中中", "x" * 9]) for _ in range(rng.randint(1, 30))) for _ in range(60)), ""]
    for n in (1, 2, 3, 13):
        h, of = udfs.gram_hashes(texts, n)
        want = [(k, " ".join(w[i : i + n])) for k, t in enumerate(texts) for w in [t.split(" ")] for i in range(len(w) - n + 1)]
        assert of.tolist() == [k for k, _ in want] and len(set(zip(h.tolist(), [g for _, g in want]))) == len(set(h.tolist())) == len({g for _, g in want})
    assert len(udfs.gram_hashes([], 3)[0]) == 0


def test_hooks(spark):
    df = spark.createDataFrame([(1, "uno dos"), (2, " "), (3, None), (4, "xx")], "id int, t string")
    got = df.select("id", udfs.detected(F.col("t"), lambda: lambda t: "es" if "dos" in t else None).alias("d"), udfs.token_count(F.col("t"), lambda: lambda t: len(t.split())).alias("n")).orderBy("id").collect()
    assert [(r["d"], r["n"]) for r in got] == [("es", 2), ("none", 0), ("none", 0), ("other", 1)]


def test_small_functions(spark):
    df = spark.createDataFrame([("es", "a", 3, None, 103.1), (None, None, 4, "q", 0.0)], "lang string, link string, number int, note string, v double")
    got = df.select(T.localised("lang", {"es": "hola"}, "hi"), T.composite_key("link", "number"), T.present_json("lang", "number", "note"), stats.change_percent(F.col("v"), F.lit(100.0)), stats.change_percent(F.col("v"), F.lit(0.0))).collect()
    assert [tuple(r) for r in got] == [("hola", "a:3", '{"lang":"es","number":3}', "+3.10%", None), ("hi", None, '{"number":4,"note":"q"}', "-100.00%", None)]
    o = spark.createDataFrame([(["x", None], 1)], "o array<string>, i int")
    with pytest.raises(Exception, match="empty option"):
        o.select(T.compacted_gold_strict("o", F.col("i"))).collect()


def test_mcnemar_published(spark):
    df = spark.createDataFrame([(1, 7), (3, 5), (0, 0), (8, 3), (3000, 3100)], "b long, c long")
    p = [r[0] for r in df.select(stats.mcnemar(F.col("b"), F.col("c"))).collect()]
    assert round(p[0], 5) == 0.07031 and round(p[1], 4) == 0.7266 and p[2] == 1 and round(p[3], 7) == 0.2265625 and 0.19 < p[4] < 0.21


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 2.0], [1.0, 2.0, 3.0])], "p array<double>, q array<double>")
    r = df.select(V.argmax(F.col("p")), V.first_divergence(F.col("p"), F.col("q")), V.first_divergence(F.col("p"), F.col("p")), V.kl(V.log_softmax(F.col("p")), V.log_softmax(F.col("p")))).first()
    assert r[0] == 1 and r[1] == 2 and r[2] is None and abs(r[3]) < 1e-12


def test_chat_and_labels(spark):
    assert one(spark, T.rendered_chat, [("user", "a")], "array<struct<role:string,content:string>>") == "<|im_start|>user\na<|im_end|>\n"
    df = spark.createDataFrame([([5, 6, 7], [(0, 2), (2, 4), (4, 9)])], "ids array<long>, offsets array<struct<start:long,end:long>>")
    assert df.select(T.loss_labels("ids", "offsets", F.lit(2), F.lit(5))).first()[0] == [-100, 6, -100]


def test_mcnemar_at_any_size(spark):
    """Equal to the sum of the tail where that can be added up, and defined far beyond."""
    import math
    from fractions import Fraction

    pairs = [(k, n - k) for n in (1, 2, 3, 7, 20, 57, 333, 1000, 10_000) for k in sorted({0, 1, 2, n // 10, n // 3, n // 2 - int(math.sqrt(n)), (n - 1) // 2, n // 2}) if 0 <= k <= n]
    df = spark.createDataFrame([(i, b, c) for i, (b, c) in enumerate(pairs)], "i int, b long, c long")
    got = {r["i"]: r["p"] for r in df.select("i", stats.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()}
    for i, (b, c) in enumerate(pairs):
        n, term, total = b + c, 1, 1
        for j in range(min(b, c)):
            term = term * (n - j) // (j + 1)
            total += term
        assert abs(got[i] - min(1.0, float(Fraction(2 * total, 2**n)))) < 1e-12, (b, c)
    n = 10**9
    far = spark.createDataFrame([(n // 2 - round(z * math.sqrt(n) / 2), n // 2 + round(z * math.sqrt(n) / 2)) for z in (0.0, 0.5, 2, 5)] + [(0, n)], "b long, c long")
    p = [r[0] for r in far.select(stats.mcnemar(F.col("b"), F.col("c"))).collect()]
    assert p[0] == 1.0 and p[4] == 0.0 and all(abs(x - math.erfc(z / math.sqrt(2))) < 1e-4 * x + 1e-4 for x, z in zip(p[1:4], (0.5, 2, 5)))
    assert one(spark, lambda v: stats.mcnemar(v, v), None, "long") is None


def test_mcnemar_is_exact_where_it_is_simple(spark):
    """One more on one side is half of the outcomes, none on one side a power of two; to the last bit."""
    halves, bare = [(k, k + 1) for k in (0, 1, 2, 5, 10, 31, 100, 1234, 10**6)], [(0, n) for n in (2, 3, 9, 17, 60, 500, 1074)]
    df = spark.createDataFrame([(i, b, c) for i, (b, c) in enumerate([*halves, *bare])], "i int, b long, c long")
    for p in (stats.mcnemar(F.col("b"), F.col("c")), stats.mcnemar(F.col("c"), F.col("b"))):
        got = [r["p"] for r in df.select("i", p.alias("p")).orderBy("i").collect()]
        assert got == [1.0] * len(halves) + [2.0 ** (1 - n) for _, n in bare]
