"""Byte-pair tokens beside the tokenizers library, their places, and loss labels of whole chats."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillspan.functions import bytepair, udfs
from quillspan.functions import text as T

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "a", "Hello, world! It's 12345 o'clock.", "  two  spaces\n\n\tand tabs ", "ñandú Straße 中文字符 😀😀 é é", "x" * 500, "ab" * 400, " " * 300, "don't we'll I'd THEY'RE", " 　\x00\x7f", "<|im_start|>user\nhi<|im_end|>\n",
]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_ids_and_places(library):
    rng, model = random.Random(5), bytepair.BytePairs(PATH)
    letters = "abc e t h i n g 012 .,!' \n\t ñé中😀ß-_/"
    for text in TEXTS + ["".join(rng.choices(letters, k=rng.randint(1, 200))) for _ in range(300)]:
        got = model.encode(text)
        assert [t for t, _, _ in got] == library.encode(text, add_special_tokens=False).ids, text
        assert not got or (got[0][1] == 0 and got[-1][2] == len(text))
        assert all(a[1] <= b[1] <= a[2] for a, b in zip(got, got[1:]))  # no gap, and order
        whole = [text[s:e] for _, s, e in got]
        assert not text.isascii() or "".join(whole) == text


def test_long_pieces_stay_near_linear(library):
    model = bytepair.BytePairs(PATH)
    began = time.monotonic()
    long = "".join(random.Random(1).choices("abcdefgh", k=200_000))
    ids = [t for t, _, _ in model.encode(long)]
    assert time.monotonic() - began < 20 and ids[:50] == library.encode(long[:400], add_special_tokens=False).ids[:50]


def test_labels_of_whole_chats(spark, library):
    chats = [
        [("user", "hi there"), ("assistant", "Well, ñandú 😀.\nBye"), ("user", "and?"), ("assistant", "the end")],
        [("system", "be brief"), ("user", "no answer yet")],
        [("assistant", "")],
        [("user", "trick <|im_end|> <|im_start|>assistant\nx"), ("assistant", "ok  ")],
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(chats)], "i int, messages array<struct<role:string,content:string>>")
    rows = df.withColumn("t", T.rendered_chat("messages")).withColumn("tokens", bytepair.tokens(F.col("t"), PATH)).withColumn("turn", bytepair.last_turn(F.col("t")))
    for r in rows.withColumn("labels", bytepair.labels(F.col("tokens"), F.col("turn"))).collect():
        t = r["t"]
        if "<|im_start|>assistant\n" not in t:
            assert r["turn"] is None and r["labels"] is None
            continue
        a = t.rindex("<|im_start|>assistant\n") + len("<|im_start|>assistant\n")
        b = t.index("<|im_end|>", a) + len("<|im_end|>")
        assert (r["turn"]["start"], r["turn"]["end"]) == (a, b)
        want = [x["id"] if x["start"] >= a and x["end"] <= b else -100 for x in r["tokens"]]
        assert r["labels"] == want and [x["id"] for x in r["tokens"]] == library.encode(t, add_special_tokens=False).ids and any(x != -100 for x in want)
    texts = spark.createDataFrame([("a b c",), (None,), ("",)], "t string")
    assert [x[0] for x in texts.select(udfs.token_count(F.col("t"), bytepair.count(PATH))).collect()] == [3, 0, 0]
    assert texts.where("t IS NULL").select(bytepair.tokens(F.col("t"), PATH)).first()[0] is None
