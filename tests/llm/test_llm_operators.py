"""Each operator beside a plain version of what it should do, on hard little inputs."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspan.llm import bpe, components, contamination, embeddings, labels, neardup, pieces, pii, quality, sharding, sstable, substrings, toxicity
from quillspan.llm.runtime import key_filter, maybe_in
from quillspan.llm.words import split_words, texts

BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def groups(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_words():
    data = ["a  b\tc", "", "é ß", " x"]
    for lo, hi, d, o in texts(pa.array([*data, None])):
        w = split_words(d, o)
        got = [bytes(d[s:e]).decode() for s, e in zip(w.start, w.end)]
        assert got == [x for t in data for x in WORD.findall(t)] and w.count.tolist() == [3, 0, 2, 1, 0]


# 1
def paths(v, b):
    if not b:
        return {(): 0.0}
    by = {v.bytes[i]: (int(i), w) for i, w in zip(v.id, v.weight)}
    out = {}
    for n in range(1, len(b) + 1):
        if b[:n] in by:
            i, w = by[b[:n]]
            out |= {(i, *rest): w + x for rest, x in paths(v, b[n:]).items()}
    return out


def test_sampling_follows_the_lattice():
    v = pieces.vocabulary(SP)
    every = paths(v, b" cat")
    total = np.logaddexp.reduce(list(every.values()))
    p = {k: np.exp(w - total) for k, w in every.items()}
    n = 6000
    data = np.frombuffer(b"cat" * n, np.uint8)
    s = pieces.Sampler(v, data, np.arange(n + 1) * 3, pieces.mix64(np.arange(n, dtype=np.uint64)))
    found = s.run(3)
    first, second, weight = defaultdict(int), defaultdict(int), 0.0
    for d, got in enumerate(found):
        ids = [tuple(s.ids([e], np.array([d]))[0].tolist()) for e, _, _ in got]
        assert len(set(ids)) == min(3, len(p)) and [x[2] for x in got] == sorted((x[2] for x in got), reverse=True)
        assert all(abs(lp - np.log(p[i])) < 1e-9 for i, (_, lp, _) in zip(ids, got))
        first[ids[0]] += 1
        second[ids[0], ids[1]] += 1
        weight += sum(np.exp(lp - pieces.log_inclusion(lp, s.kappa[d])) for _, lp, _ in got)
    for k, q in p.items():
        assert abs(first[k] / n - q) < 0.03
        for m, r in p.items():
            if m != k:
                assert abs(second[k, m] / n - q * r / (1 - q)) < 0.03
    assert abs(weight / n - 1) < 0.05  # inverse inclusion weights are unbiased


def test_pieces(docs, empty, spark):
    rows = pieces.sampled(docs, SP, k=2).collect()
    assert all(r["decoded"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert [len(by[i]) for i in (200, 201, 202, 206)] == [1, 1, 2, 2] and by[200][0]["n_tokens"] == 0
    assert by[0][0]["ids_crc32"] == zlib.crc32(np.array(by[0][0]["ids"], "<u4").tobytes())
    again = {(r["doc_id"], r["sample"]): r["ids"] for r in pieces.sampled(docs.repartition(7), SP, k=2).collect()}
    assert all(again[r["doc_id"], r["sample"]] == r["ids"] for r in rows)
    odd = spark.createDataFrame([(1, "日本 ▁é\n\t 😀  a"), (2, "a" * 3000), (3, "  ")], "doc_id long, text string")
    assert all(r["decoded"] for r in pieces.sampled(odd, SP).collect())
    back = {r["doc_id"]: r["text"] for r in pieces.decoded(pieces.encoded(odd, SP), SP).collect()}
    assert back == {1: "日本 ▁é\n\t 😀  a", 2: "a" * 3000, 3: "  "}
    assert pieces.sampled(empty, SP).count() == 0


# 2
def test_contamination(docs, corpus, spark, empty):
    items = [(1, corpus[125 - 100 + 30][1] or "x"), (2, " ".join(f"z{i}" for i in range(30))), (3, "one"), (4, None), (5, " "), (6, "a b c")]
    passage = corpus[-1][1].split()[:33]
    edited = list(passage)
    edited[3] = "changed"
    items += [(7, " ".join(passage)), (8, " ".join(edited)), (9, " ".join(passage[:12])), (7, " ".join(passage))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in contamination.contaminated(docs, bench).collect() if r["doc_id"] is not None)
    want = []
    for i, t in corpus:
        own = shingles(t, 5)
        for k, x in items:
            q = shingles(x, 5)
            if q and len(q & own) >= 0.8 * len(q):
                want.append((i, k, len(q), len(q & own)))
    assert got == sorted(want) and len(got) > 10
    kept = contamination.clean(docs, bench)
    assert kept.columns == docs.columns and kept.where("doc_id IS NULL").count() == 1
    assert contamination.contaminated(empty, bench).count() == 0 and contamination.contaminated(docs, bench.limit(0)).count() == 0


# 3
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in v.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def base_spans(t):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if valid(k, m.group()))


def test_pii(spark, empty):
    hard = ["mail a@b.c.@d.e now", "x@y", "x@y.z. 1.2.3.4.5 300.1.1.1 01.002.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112 +1 (555) 123-4567 x +12 3", "é@b.co ü +491234567890 " * 3, None, ""]
    hard += ["a" * 3000, "1" * 2000, "+" * 50 + "1 2", "@.@.a@b-c.d-e.f@g.h", "1.1.1.1" * 300, "a@b" + ".c" * 20000, "中 1.2.3.4 😀 b@c.de"]
    told = [f"see filler{i} of boss at boss@corp.com on Zebrafish plan filler{i * 7}" for i in range(8)] + ["the plan to see words at of boss on corp"] * 40
    rows = list(enumerate(hard + told))
    df = spark.createDataFrame([(i, t, "k") for i, t in rows] + [(None, "b@c.de", "k")], "doc_id long, text string, base string")
    got = {r["doc_id"]: r for r in pii.detected(df).collect()}
    for i, t in rows:
        want = base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got[i]["spans"].startswith(want)
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [want.count(k + ":") for k in PATTERNS]
    assert got[None]["n_email"] == 1
    where = told[0].index("Zebrafish")
    assert f"term:{where}:{where + 9}" in got[len(hard)]["spans"] and got[len(hard) + 20]["n_terms"] == 0
    clean = pii.sanitised(df)
    assert clean.columns == df.columns
    out = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert out[5] is None and out[6] == "" and out[3] == "[CARD] and 4111-1111-1111-1112 [PHONE] x +12 3" and "Zebrafish" not in out[len(hard)] and "[EMAIL]" in out[len(hard)]
    assert out[len(hard) + 20] == told[20]
    assert pii.detected(empty).count() == 0 and pii.sanitised(empty).count() == 0


def test_prefix_sums(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 127, 128, 129, 700)], "v array<long>")
    for r in df.select("v", pii.prefix_sums(F.col("v")).alias("s")).collect():
        assert r["s"] == np.cumsum(r["v"]).tolist()


# 4
def removed(rows, length=20):
    first, out = {}, {}
    for d, w in sorted(rows.items()):
        for i in range(len(w) - length + 1):
            first.setdefault(tuple(w[i : i + length]), (d, i))
    for d, w in rows.items():
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if first[tuple(w[i : i + length])] != (d, i):
                gone[i : i + length] = [True] * length
        out[d] = gone
    return out


def check_substrings(spark, rows, parts=3):
    df = spark.createDataFrame([(i, t, 0) for i, t in rows.items()], "doc_id long, text string, d int").repartition(parts)
    w = {i: WORD.findall(t or "") for i, t in rows.items()}
    gone = removed(w)
    for r in substrings.deduplicated(df).collect():
        i = r["doc_id"]
        kept = " ".join(x for x, g in zip(w[i], gone[i]) if not g)
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == (len(w[i]), sum(gone[i]), kept), i
        assert r["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
        assert sum(x["end"] - x["start"] for x in r["repeats"]) == sum(gone[i])


def test_substrings(spark, corpus, docs, empty):
    check_substrings(spark, dict(corpus))
    rng = random.Random(3)
    few = {i: " ".join(rng.choice("ab") for _ in range(rng.randint(0, 120))) for i in range(30)} | {-5: "a " * 300, 50: "b " * 19, 51: "b " * 20}
    check_substrings(spark, few)
    parts = [" ".join(f"{c}{i}" for i in range(rng.randint(8, 40))) for c in "abcdefgh"]
    check_substrings(spark, {i: " ".join(rng.choice(parts) for _ in range(6)) for i in range(60)}, parts=8)
    assert substrings.deduplicated(docs).where("doc_id IS NULL").first()["n_removed"] == 0
    assert substrings.deduplicated(empty).count() == 0


# 5
def test_sharding(docs, spark, empty):
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 101)
    counts = np.bincount(table)
    assert table.min() >= 0 and counts.max() - counts.min() <= 1
    # plain version of taking turns
    prefer = [[(sharding._number(f"{s}|offset") % 101 + j * (sharding._number(f"{s}|skip") % 100 + 1)) % 101 for j in range(101)] for s in names]
    slots, turn = {}, 0
    while len(slots) < 101:
        slots[next(x for x in prefer[turn % 7] if x not in slots)] = turn % 7
        turn += 1
    assert [slots[i] for i in range(101)] == table.tolist()
    fewer = sharding.lookup_table(names[:-1], 101)
    assert (fewer != table)[table != 6].sum() < 35
    for bad in ((names, 100), ([], 101), (["a", "a"], 101)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)
    rows = sharding.place(docs, shards=names, table_size=101).collect()
    assert len(rows) == docs.count()
    for r in rows:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % 101
        assert r["slot"] == slot and r["shard"] == names[table[slot]]
    assert sharding.place(empty).count() == 0
    assert abs(sharding.lookup_table(["a", "b"], 101, [3, 1]).tolist().count(0) - 76) <= 1


def test_write_sharded(docs, spark, tmp_path):
    sharding.write_sharded(docs, str(tmp_path / "s"), shards=["a", "b"])
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()


# 6
def test_quality(spark, docs, empty):
    rng = random.Random(2)
    good = [" ".join(rng.choice(["the", "of", "a", "stone", "river", "light", "walks", "seen"]) for _ in range(rng.randint(5, 60))).capitalize() + "." for _ in range(150)]
    bad = [" ".join(x.upper() + "!!" for x in g.split()) if i % 2 else " ".join(f"{x}$$$" for x in g.split()) for i, g in enumerate(good)]
    rows = pa.table({"text": good[:120] + bad[:120], "label": [1] * 120 + [0] * 120})
    net = quality.fit(rows)
    held = spark.createDataFrame(list(enumerate(good[120:] + bad[120:])), "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.scored(held, net).collect()}
    assert sum(got[i]["predicted"] == (i < 30) for i in got) >= 58
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert quality.scored(docs, net).count() == docs.count() and quality.scored(empty, net).count() == 0
    assert quality.accepted(docs, net).columns == docs.columns
    assert quality.probabilities(quality.fit(rows.slice(0, 5)), np.zeros(0, np.uint8), np.zeros(2, np.int64))[0] > 0.8
    # max-pooling over slices of one text equals that of the whole
    raw = np.frombuffer(good[0].encode() * 50, np.uint8)
    blocks, equal, first = quality.blocks(raw, np.array([0, len(raw)]))
    y = quality._responses(net, quality._inputs(net, blocks, equal))
    assert np.allclose(quality.pooled(net, raw, np.array([0, len(raw)]))[0], np.maximum(y.max(0) + net.bias, 0), atol=1e-5)


def test_samples(spark, docs):
    lab = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    got = labels.sample(docs, lab, "quality", 5, 10_000).to_pylist()
    assert len(got) == 10 and sum(r["label"] for r in got) == 5
    assert labels.sample(docs, lab.limit(0), "quality", 5, 100).num_rows == 0


# 7
def test_embeddings(spark, empty):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(30):
        rows.append((100 + i, (base[i % 6] + rng.normal(size=64) * rng.uniform(0.02, 0.2)).tolist()))
    rows += [(200, base[0].tolist()), (201, (base[0] * 3).tolist()), (202, None), (203, [0.0] * 64), (204, [float("nan")] + [1.0] * 63), (205, [None] + [1.0] * 63), (206, []), (207, base[1][:32].tolist())]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, id int").repartition(4)
    ok = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if v and len(v) == 64 and None not in v and np.isfinite(v).all() and np.any(v)]
    pairs = [(a, b) for x, (a, u) in enumerate(ok) for b, v in ok[:x] if u @ v >= 0.95]
    want = groups([i for i, _ in rows], pairs)
    n = defaultdict(int)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    got = {r["vec_id"]: r for r in embeddings.linked(df).collect()}
    assert len(pairs) > 40 and all(got[i]["n_links"] == n[i] and got[i]["component_id"] == want[i] and got[i]["kept"] == (want[i] == i) for i, _ in rows)
    small, embeddings.BLOCK = embeddings.BLOCK, 4
    try:
        assert {r["vec_id"]: r["n_links"] for r in embeddings.linked(df).collect()} == {i: r["n_links"] for i, r in got.items()}
    finally:
        embeddings.BLOCK = small
    assert embeddings.linked(df.limit(0)).count() == 0


def test_embeddings_of_any_length_and_size(spark):
    """Links among vectors of rarer lengths, and of components whose squares overflow or vanish, however rows fall into batches."""
    rng = np.random.default_rng(2)
    rows, near = [], []
    for k, dim in enumerate([64] * 30 + [1, 2, 3, 8, 31, 32, 200]):
        v = rng.normal(size=dim)
        rows += [(10 * k + i, x.tolist()) for i, x in enumerate((v, v, v * 1.5, v + rng.normal(size=dim) * 0.05 * np.abs(v)))]
    v = rng.normal(size=16)
    rows += [(1000 + i, (v * size).tolist()) for i, size in enumerate((1e-200, 1e-200, 1.0, 1e200, 1e300))] + [(1010, [5e-324, 0.0]), (1011, [5e-324, 0.0]), (1012, [0.0, 0.0]), (1013, [float("inf"), 1.0])]

    def unit(x):
        if not np.isfinite(x).all() or not np.any(x):
            return None
        x = np.array(x) / np.abs(x).max()
        return x / np.linalg.norm(x)

    n, units = defaultdict(int), [(i, unit(x)) for i, x in rows]
    for at, (a, u) in enumerate(units):
        for b, w in units[:at]:
            if u is not None and w is not None and len(u) == len(w) and u @ w >= 0.95:
                near.append((a, b))
                n[a] += 1
                n[b] += 1
    want = groups([i for i, _ in rows], near)
    assert all(n[i] for i in (300, 310, 320, 330, 340, 350, 360, 1000, 1003, 1010)) and not n[1012] and not n[1013]
    for parts in (1, 9):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
        got = {r["vec_id"]: r for r in embeddings.linked(df).collect()}
        assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n[i], want[i], want[i] == i) for i, _ in rows)


def test_lattice():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 3
    best, other = embeddings.nearest_e8(x)
    near = np.concatenate([np.zeros((1, 8), np.int64), embeddings._NEIGHBOURS])
    assert len(embeddings._NEIGHBOURS) == 240 and ((best % 2).sum(1) % 8 == 0).all()
    d = ((2 * x - best) ** 2).sum(1)
    assert all((((2 * x - best - v) ** 2).sum(1) >= d - 1e-9).all() for v in near)
    assert (((2 * x - other) ** 2).sum(1) >= d - 1e-9).all()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(1)[:, None] * x
    y /= np.linalg.norm(y, axis=1)[:, None]
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * y
    scale = embeddings.SCALE * np.sqrt(8 / 64)
    a, b = (embeddings.cells(v, scale, embeddings.TABLES, embeddings.PROBES) for v in (x, y))
    assert ((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)).any(1).mean() > 0.99


# 8
def test_bpe_is_exact():
    odd = [" a  b  c　 d", "", " ", "<|endoftext|> x", "it's  \n\n x  y é   z", "  lead", "a'b don't !'s '' 12'34 x' y 'z", "é, à! ×÷a ñ.", "a.\nB\n\nC \n d\te", "中文 字, x", "a\x1cb \x1d c", "x\x00y"]
    rng = random.Random(0)
    odd += ["".join(rng.choice("ab é'.,1 \n\t!ñ中ß×") for _ in range(200)) for _ in range(200)]
    end = "<|endoftext|>"
    odd += [f"a{end}b", f"{end}{end}", f" {end} {end}\n\n{end}\n x", f"don{end}'t{end}1", "<|endof", "text|>", f"a  {end}", f"  {end}  b", "<|endoftext |>"]
    odd += ["".join(rng.choice(["a", " ", "'", "\n", "<|", "|>", "endoftext", end, "1", "é"]) for _ in range(60)) for _ in range(200)]
    t = Tokenizer.from_file(BPE)
    e = bpe.ChunkEncoder(BPE)
    for lo, hi, d, o in texts(pa.array([*odd, None])):
        ids, n = e.encode(d, o)
        got = [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [x.ids for x in t.encode_batch([*odd, ""], add_special_tokens=False)]


def test_sstable(docs, empty, spark):
    """Beside the library's own ids of whole texts; files in several groups; a special token, a text longer than a shard, repeated and null ids."""
    t = Tokenizer.from_file(BPE)
    more = [(900, "a<|endoftext|>b", "x", 1, "y"), (901, "word " * 20_000, "x", 1, "y"), (902, "the same row", "x", 1, "y"), (902, "the same row", "x", 1, "y"), (None, None, "x", 1, "y")]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    small, sstable.BLOCK_BYTES, sstable.FILES = sstable.BLOCK_BYTES, 64, 2
    whole, sstable.write_tables = sstable.write_tables, lambda *a, **b: plain(*a, **b, shard_bytes=20_000)
    plain = whole
    try:
        order = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)
        hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).collect()
        rows = sorted(hashed, key=lambda r: (*order(r), r["h"]))
        got = sorted(sstable.token_ids(docs, BPE).collect(), key=lambda r: r["start"])
    finally:
        sstable.BLOCK_BYTES, sstable.FILES, sstable.write_tables = small, 1000, whole
    at = 0
    for r, g in zip(rows, got, strict=True):
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        assert (g["doc_id"], g["start"], g["n_tokens"], g["ids_crc32"]) == (r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert sstable.token_ids(empty, BPE).count() == 0


def test_lookup_in_files(spark, docs, tmp_path):
    """Single documents by binary search over files and blocks, beside the library's ids; only parts of a file are read."""
    path = str(tmp_path / "shards")
    sstable.write_tables(docs, path, BPE, shard_bytes=4000)
    t = Tokenizer.from_file(BPE)
    for r in docs.where("doc_id IS NULL OR doc_id % 9 = 0").collect():
        assert sstable.lookup(spark, path, r["doc_id"]).tolist() == [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
    assert all(sstable.lookup(spark, path, i) is None for i in (-7, 95, 10**12)) and sstable.lookup(spark, str(tmp_path / "none"), 1) is None
    w, read = sstable.TableWriter(4), []
    raw = b"".join(s + b"\n" for k in range(3000) for s in w.add(sstable.key_of(k), np.random.default_rng(k).bytes(800))) + b"".join(s + b"\n" for s in w.finish())
    table = sstable.Table(lambda at, n: read.append(n) or raw[at : at + n], len(raw))
    assert table.get(1234).tobytes() == np.random.default_rng(1234).bytes(800) and table.get(9999) is None and sum(read) < len(raw) / 20


def test_table_lookup():
    for width, top in ((2, 60_000), (4, 1 << 20)):
        w = sstable.TableWriter(width)
        rng = random.Random(width)
        ids = sorted(rng.sample(range(-(1 << 40), 1 << 62), 500))
        values = {i: [rng.randrange(top) for _ in range(rng.randint(0, 400))] for i in [None, *ids]}
        raw = b"".join(s + b"\n" for k in [None, *ids] for s in w.add(sstable.key_of(k), np.array(values[k], f"<u{width}").tobytes()))
        raw += b"".join(s + b"\n" for s in w.finish())
        table = sstable.Table(raw)
        assert len(table.places) > 3 and [sstable.id_of(k) for k, _ in table.entries()] == [None, *ids]
        assert all(table.get(i).tolist() == values[i] for i in [None, *ids[::7]])
        missing = [i + 1 for i in ids if i + 1 not in values]
        assert all(table.get(i) is None for i in missing) and table.get((1 << 63) - 1) is None
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(sstable.Table(raw[:20] + bytes([raw[20] ^ 1]) + raw[21:]).entries())


# 9
def test_neardup(spark, corpus, empty):
    rng = random.Random(7)
    base = [f"t{i}" for i in range(120)]
    rows = dict(corpus)
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"u{rng.randrange(1000)}"
        rows[300 + i] = " ".join(w)
    sets = {i: shingles(t, 2) for i, t in rows.items()}
    ids = sorted(rows)
    linked = [(a, b) for x, a in enumerate(ids) for b in ids[:x] if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = groups(ids, linked)
    df = spark.createDataFrame([(i, t, "a", 2) for i, t in rows.items()] + [(None, "null id", "a", 2)], "doc_id long, text string, x string, component long").repartition(4)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(df).collect()}
    assert len(linked) > 200
    for i in ids:
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), want[i], want[i] == i)
    assert got[None]["component_id"] is None and got[None]["kept"]
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns and sorted(r[0] for r in kept.where("doc_id IS NOT NULL").select("doc_id").collect()) == sorted(set(want.values()))
    assert neardup.near_duplicates(empty).count() == 0
    assert neardup.near_duplicates(df.where("doc_id < 3")).count() == 3


def test_deduplicated_by_row(spark):
    """Repeated and null ids with equal and with different texts."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(3, b), (7, a), (7, b), (8, c), (8, c), (8, c), (None, d), (None, d), (9, d), (None, "other text"), (None, "third one here"), (10, ""), (10, ""), (10, None), (11, None)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    kept = neardup.deduplicated(df)
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    want = [(3, b), (7, a), (8, c), (None, d), (None, "other text"), (None, "third one here"), (10, ""), (10, None), (11, None)]
    assert kept.columns == df.columns and sorted(got, key=str) == sorted(want, key=str)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(i, i + 1) for i in range(400, 430)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    want = groups(nodes, [(a, b) for a, b in pairs if a != b])
    assert got == want


def test_key_filter(spark):
    keys = spark.range(0, 5000, 7).select("id")
    bits = key_filter(keys)
    hit = spark.range(5000).where(maybe_in(spark, bits)(F.col("id")))
    assert keys.join(hit, "id").count() == keys.count() and hit.count() < keys.count() + 60


# 10
def test_toxicity(spark, docs, empty):
    rng = random.Random(9)
    plain = ["stone", "river", "light", "walks", "seen", "und", "grün"]
    bad = ["idiot", "moron", "stupid", "worthless"]
    texts_ = [" ".join(rng.choice(plain) for _ in range(rng.randint(3, 80))) for _ in range(400)]
    toxic = [i % 3 == 0 for i in range(400)]
    texts_ = [f"{t} {rng.choice(bad)}, {t}" if y else t for t, y in zip(texts_, toxic)]
    chain = toxicity.fit_table(pa.table({"text": texts_[:300], "label": [int(y) for y in toxic[:300]]}))
    assert chain.categories == ("kind_1", "kind_2", "toxic") and [len(w) for w in chain.weights] == [len(chain.words) + 1 + i for i in range(3)]
    held = spark.createDataFrame(list(enumerate(texts_[300:])), "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.scored(held, chain).collect()}
    assert sum(got[i]["predicted"] == int(toxic[300 + i]) for i in got) >= 98
    assert all(0 <= got[i][f"p_{c}"] <= 1 for i in got for c in chain.categories)
    assert toxicity.scored(docs, chain).count() == docs.count() and toxicity.scored(empty, chain).count() == 0
    assert toxicity.fit_table(pa.table({"text": pa.array([], pa.string()), "label": pa.array([], pa.int32())})).categories == chain.categories


def test_chain_by_its_definition():
    """Each model is where the penalised loss is least, on words and on out-of-fold probabilities of the categories before; applying feeds its own predictions forward."""
    rng = random.Random(3)
    groups = (["bada", "badb", "badc"], ["vilea", "vileb"])
    rows, label = [], []
    for i in range(500):
        kind = rng.choice([None, None, 0, 1])
        own = [rng.choice(["red", "green", "blue", "tree", "badb", "vileb"] if rng.random() < 0.02 else ["red", "green", "blue", "tree"]) for _ in range(rng.randint(2, 12))]
        rows.append(" ".join(own + ([] if kind is None else rng.sample(groups[kind], 2))))
        label.append(int(kind is not None) if rng.random() > 0.03 else 0)
    data, offsets = next(texts(pa.array(rows), 1 << 40))[2:]
    y = np.array(label)
    named = toxicity.kind_labels(y, data, offsets)
    assert (sum(named[c] for c in ("kind_1", "kind_2")) == y).all()
    of = [{0, 1} & {g for g in (0, 1) if set(r.split()) & set(groups[g])} for r in rows]
    assert all(len({named["kind_1"][i] for i in range(500) if y[i] and of[i] == {g}}) == 1 for g in (0, 1))  # a cluster for each vocabulary
    fold = toxicity.folds(500)
    chain = toxicity.fit(named, data, offsets, fold)
    x = toxicity.features(chain.words, data, offsets).astype(float)
    own = {w: set(toxicity.present(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[1].tolist()) for w in {w for r in rows for w in r.split()}}
    assert own["vilea"] & own["vileb"] and not own["red"] & own["tree"]  # a stem in common
    for j, h in enumerate(chain.words.tolist()):
        assert (x[:, j] == [any(h in own[w] for w in r.split()) for r in rows]).all()

    def slope(design, target, w):
        design = np.hstack([design, np.ones((len(design), 1))])
        ridge = np.append(np.full(len(w) - 1, toxicity.RIDGE), 1e-3)
        return np.abs(design.T @ (target - 1 / (1 + np.exp(-design @ w))) - ridge * w).max()

    before = np.zeros((500, 0))
    for (name, target), w in zip(named.items(), chain.weights):
        design = np.hstack([x, before])
        assert slope(design, target, w) < 1e-3, name
        unseen = np.zeros(500)
        for f in range(5):
            rest = fold != f
            model = toxicity.logistic(design[rest], target[rest])
            assert slope(design[rest], target[rest], model) < 1e-3
            unseen[~rest] = 1 / (1 + np.exp(-(design[~rest] @ model[:-1] + model[-1])))
        assert np.allclose(unseen, toxicity.out_of_fold(design, target, fold, w), atol=1e-9)
        before = np.hstack([before, unseen[:, None]])
    got, own = toxicity.apply(chain, x), np.zeros((500, 0))
    for w in chain.weights:
        own = np.hstack([own, 1 / (1 + np.exp(-(np.hstack([x, own]) @ w[:-1] + w[-1])))[:, None]])
    assert np.allclose(got, own, atol=1e-9)


def test_network_by_its_definition():
    """Each filter over each run of blocks of a padded text, one by one; long texts slice by slice."""
    rng = np.random.default_rng(5)
    B, S = quality.BLOCK, quality.SPAN
    net = quality.Network(rng.normal(size=(256, quality.DIM)).astype(np.float32), rng.normal(size=(S, B * quality.DIM + quality.LAGS - 1, 4)).astype(np.float32), rng.normal(size=4).astype(np.float32), rng.normal(size=4).astype(np.float32), 0.1)
    every = ["", "a", "the same the same", "é" * 40, "x" * 23, "x" * 24, "x" * 25, "".join(map(chr, rng.integers(32, 500, 300)))]

    def plain(t):
        raw = t.encode()
        n = max(S, -(-len(raw) // B))
        raw = raw + bytes(n * B - len(raw))
        rows = []
        for b in range(n):
            equal = [sum(raw[i] == raw[i - lag] and raw[i] > 0 for i in range(b * B, b * B + B) if i >= lag) / B for lag in range(2, quality.LAGS + 1)]
            rows.append(np.concatenate([*(net.table[c] for c in raw[b * B : b * B + B]), equal]))
        best = np.max([sum(rows[b + s] @ net.filters[s] for s in range(S)) for b in range(n - S + 1)], axis=0)
        z = np.maximum(best + net.bias, 0) @ net.out + net.shift
        return 1 / (1 + np.exp(-z))

    want = np.array([plain(t) for t in every])
    data, offsets = next(texts(pa.array(every), 1 << 40))[2:]
    assert np.allclose(quality.probabilities(net, data, offsets), want, atol=1e-4)
    for t in every:
        raw = np.frombuffer(t.encode(), np.uint8)
        for size in (8, 16, 24, 64, 4096):
            assert np.allclose(quality.pooled_long(net, raw, size), quality.pooled(net, raw, np.array([0, len(raw)])), atol=1e-4), (t, size)


DATA = Path("/root/testdata/sf0.1")


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_held_out_accuracy(spark):
    """Of texts that no fitting saw: quality and toxicity as the labels mark them."""
    docs, marks = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    for name, label, least, scored in (("quality", "quality", 0.95, lambda: quality.scored(docs, quality.train(docs, marks))), ("toxicity", "toxic", 0.9, lambda: toxicity.scored(docs, toxicity.train(docs, marks)))):
        rows = scored().where("held_out").join(marks, "doc_id").select("predicted", F.col(label).alias("y")).toPandas()
        right = {c: float((rows[rows.y == c].predicted == c).mean()) for c in (0, 1)}
        assert len(rows) > 500 and float((rows.predicted == rows.y).mean()) > least, (name, right)
        print(name, len(rows), right)
