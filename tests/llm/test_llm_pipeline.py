"""The pipeline's stages on small documents, each beside what it should keep."""

import zlib

import corpus_pipeline as P
import numpy as np
import public_tokenizers

from quillspan.llm import neardup, pieces, queries


def test_stages(spark, tmp_path, corpus):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in corpus] + [(500, f"mail me@x.org {corpus[0][1]} at once", "en", "s", 5), (501, "GO!! STOP!! NOW!! " * 15, "en", "s", 270)]
    rows += [(600 + i, " ".join(("GO!! STOP!! NOW!!" if i % 2 else "a calm river walks by").split() * 9), "en", "s", 9) for i in range(60)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(600 + i, 1 - i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(corpus[-1][1].split()[:33]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "pieces"]
    kept = {}
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
    assert 501 not in kept["quality"] and 0 in kept["quality"]
    assert 0 in kept["near_dedup"] and not {100, 101, 204} & set(kept["near_dedup"])
    assert not {120, 207} & set(kept["decontamination"]) and 0 in kept["decontamination"]
    if 500 in kept["pii"]:
        assert "[EMAIL]" in kept["pii"][500]["text"] and kept["pii"][500]["n_chars"] == len(kept["pii"][500]["text"])
    assert P.run(spark, d).select("doc_id").distinct().count() == len(kept["pii"])


def test_result_has_the_encoded_corpus(spark, tmp_path, docs):
    """The ids of the last stage and of op1 give back each document's text."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    model = public_tokenizers.path("piece_bpe_32k.model")
    want = sorted((r["doc_id"] or -1, r["text"] or "") for r in docs.collect())
    for out in (P.pieces_stage(spark, docs, str(tmp_path)), queries.op1_pieces(spark, str(tmp_path))):
        out = out.cache()
        assert all(r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in out.collect())
        for rank in (1, 2):
            back = sorted((r["doc_id"] or -1, r["text"]) for r in pieces.decoded(out.where(f"sample = {rank}"), model).collect())
            assert back == [w for w in want if w[1] or rank == 1]


def test_near_dedup_takes_five_words(spark, tmp_path):
    """One word in 20 changed: alike by two-word shingles, not by five-word ones."""
    words = [f"w{i}" for i in range(200)]
    far = [f"x{i}" if i % 20 == 10 else w for i, w in enumerate(words)]
    near = [*words[:100], "y", *words[101:]]
    rows = [(i, " ".join(w), "en") for i, w in enumerate((words, far, near, ["a", "b"], ["A", "b"], ["a", "c"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in P.neardup_stage(spark, docs, str(tmp_path)).collect()) == [0, 1, 3, 5]
    assert sorted(r["doc_id"] for r in neardup.deduplicated(docs).collect()) == [0, 3, 5]


def test_op5_shards_whole_documents(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op5_sharding(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "slot", "shard"]
    assert sorted(map(str, out.drop("slot", "shard").collect())) == sorted(map(str, docs.collect()))
