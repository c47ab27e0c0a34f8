"""Strings that defeat linear hashes, clashing names, repeated and null ids, empty and very long texts; disclosure by its definition."""

import hashlib
import random
import re
from collections import defaultdict
from pathlib import Path

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspan.llm import bpe, contamination, embeddings, neardup, pieces, pii, quality, runtime, sharding, substrings, toxicity, words

BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Names that operators use inside.
CLASH = "id row key key2 n text_x component hits found all hit block probe star leader state class _id _row _doc _null slot shard item q label"


def twins(n=2048):
    """Two different words whose polynomial hashes agree modulo 2**64 for any odd base."""
    t = [0]
    while len(t) < n:
        t += [1 - x for x in t]
    return "".join("ab"[x] for x in t), "".join("ab"[1 - x] for x in t)


def clashing(spark, rows, parts=3):
    names = CLASH.split()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("doc_id", "text", *(F.lit(f"own {c}").alias(c) for c in names)).repartition(parts)


def test_twins_stay_apart(spark):
    a, b = twins()
    assert a != b
    for data in (" ".join([a, b]), " ".join(" ".join(x) for x in (a[:16], b[:16]))):
        raw = np.frombuffer(data.encode(), np.uint8)
        w = words.split_words(raw, np.array([0, len(raw)]))
        got = WORD.findall(data)
        assert len(set(w.hash.tolist())) == len(set(got)) == len(set(w.second.tolist()))
        for size in (2, 5, 16):
            h, _ = words.shingles(w, size)
            assert len(set(h.tolist())) == len({tuple(got[i : i + size]) for i in range(max(1, len(got) - size + 1))})
    rest = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{a} {rest}")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substrings.deduplicated(docs, with_text=False).collect()} == {1: 0, 2: 0, 3: 20}
    pair = spark.createDataFrame([(1, f"{a} x"), (2, f"{b} x"), (3, f"{a} x")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(pair).collect()} == {1: 1, 2: 2, 3: 1}
    item = spark.createDataFrame([(7, f"{b} one two three four")], "item_id long, text string")
    found = contamination.contaminated(spark.createDataFrame([(1, f"{a} one two three four"), (2, f"x {b} one two three four")], "doc_id long, text string"), item)
    assert [r["doc_id"] for r in found.collect()] == [2]
    tokenizer, encoder = Tokenizer.from_file(BPE), bpe.ChunkEncoder(BPE)
    for lo, hi, data, offsets in words.texts(pa.array([a, b])):
        ids, n = encoder.encode(data, offsets)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in (a, b)]
    assert all(r["decoded"] for r in pieces.sampled(docs, SP).collect())


# 2
def shingles(text, n=5):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_contamination_broadcast_and_joined(spark, corpus, empty, most):
    """Alike whether the benchmark is broadcast or joined; items of one to four words and of one to eight shingles; rows that share an id or have none; a column with a dot."""
    rng = random.Random(6)
    long = corpus[-2][1]
    w = WORD.findall(long)
    items = [(i, " ".join(w[s : s + n])) for i, (s, n) in enumerate([(10, 5), (50, 6), (90, 7), (200, 8), (300, 9), (400, 12), (600, 40), (1000, 300), (0, 5), (len(w) - 5, 5)])]
    items += [(20, "one"), (21, "a b c"), (22, None), (23, " "), (24, " ".join(w[700:712] + ["other"] * 2)), (24, " ".join(w[700:712] + ["other"] * 2))]
    rows = [*corpus, (None, f"x {items[5][1]} y"), (None, "clean words here and there"), (0, f"{items[6][1]}"), (0, "a b c"), (0, "a b c"), (300, "ONE"), (301, "one two")]
    items += [(25, "alpha beta gamma"), (26, "Delta"), (27, "p q r s"), (28, " ".join(w[800:804])), (29, "p q")]
    rows += [(302, "a longer text, alpha BETA gamma and more"), (303, "alpha beta delta gamma"), (304, "p q r s"), (305, "p q r"), (306, "x p\tq  r\n s x"), (307, "alpha beta gammas")]
    rows += [(400 + i, " ".join(rng.sample(w, 30) + w[200:208] + rng.sample(w, 10))) for i in range(5)]
    docs, bench = clashing(spark, rows).withColumn("a.dot", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    old, contamination.MOST_BYTES = contamination.MOST_BYTES, most
    try:
        got = sorted(((r["doc_id"], r["item_id"], r["n_item"], r["n_shared"]) for r in contamination.contaminated(docs, bench).collect()), key=str)
        kept = contamination.clean(docs, bench)
        left = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
        assert contamination.contaminated(empty, bench).count() == 0 and contamination.contaminated(docs, bench.limit(0)).count() == 0
        assert contamination.clean(empty, bench).count() == 0 and contamination.clean(docs, bench.limit(0)).count() == len(rows)
    finally:
        contamination.MOST_BYTES = old
    def hit(t):
        out = []
        for k, x in items:
            n = min(5, len(WORD.findall(x or ""))) or 5  # an item under five words is one run of them
            own = {s for s in shingles(t, n) if len(s) == n}
            if (q := shingles(x)) and len(q & own) >= 0.8 * len(q):
                out.append((k, len(q), len(q & own)))
        return out

    assert got == sorted(((i, *h) for i, t in rows for h in hit(t)), key=str) and len(got) > 20
    assert left == sorted(((i, t) for i, t in rows if not hit(t)), key=str) and kept.columns == docs.columns


def test_contamination_recall_at_the_threshold():
    """Items of 5 to 200 shingles in long documents, a fifth of their shingles changed: how many are candidates."""
    rng = np.random.default_rng(7)
    sizes = rng.integers(5, 201, 400)
    sets = [np.sort(rng.integers(1, 2**63, n, dtype=np.uint64)) for n in sizes]
    index = contamination.ItemIndex(list(range(400)), sets, [b""] * 400, [99] * 400)
    found = 0
    for k, own in enumerate(sets):
        part = rng.permutation(own)
        part[: int(0.2 * len(part))] = rng.integers(1, 2**63, int(0.2 * len(part)), dtype=np.uint64)
        at = int(rng.integers(0, 3000))
        doc = np.concatenate([rng.integers(1, 2**63, at, dtype=np.uint64), part, rng.integers(1, 2**63, 500, dtype=np.uint64)])
        docs, items = index.search(None, doc, np.array([0, len(doc)]))
        found += k in items.tolist()
    assert found == 400


# 3
def base_spans(text):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"}
    return [(k, m.start(), m.end(), m.group().lower()) for k, p in patterns.items() for m in re.finditer(p, text) if k != "ip" or all(int(x) <= 255 for x in m.group().split("."))]


def disclosing(rows):
    """Term -> smoothed probability, from the definition, text by text."""
    strip = lambda w: w.lower().strip(pii._MARKS)
    pairs, total = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for t in rows:
        for w in WORD.findall(t):
            total[strip(w)] += 1
        for kind, s, e, value in base_spans(t):
            left, right = t[max(0, s - pii.REACH) : s], t[e : e + pii.REACH + 1]
            around = (t[: s] if s <= pii.REACH else left, right)
            spans = [(m.start(), m.end()) for m in WORD.finditer(t)]
            inside = [t[a:b] for a, b in spans if (a > s - pii.REACH or s <= pii.REACH) and b <= s - 1 + (0 if b < s else -1) or a > e and b <= e + pii.REACH]
            for w in inside:
                term = strip(w)
                if len(term) > 1 and "@" not in term and not re.fullmatch(r"[0-9+().-]*", term):
                    pairs[kind + value, term][around] += 1
    out = defaultdict(float)
    for (_, term), contexts in pairs.items():
        k = len(contexts)
        if k > 1:
            joint = min(sum(contexts.values()), total[term])
            out[term] = max(out[term], joint / total[term] * k / (k + 1))
    return {t: p for t, p in out.items() if p > pii.GENERALISE}


def test_disclosure_by_its_definition(spark):
    rng = random.Random(12)
    common = [f"word{i}" for i in range(30)]
    people = {f"p{i}@corp.org": [f"Nick{i}x", f"(street-{i})", f"Sometimes{i}"] for i in range(6)}
    texts = []
    for i in range(160):
        t = [rng.choice(common) for _ in range(rng.randint(5, 40))]
        if i % 2:
            who, own = rng.choice(list(people.items()))
            at = rng.randrange(len(t))
            t[at:at] = [rng.choice(common), own[0] if rng.random() < 0.8 else "else", who, own[1], rng.choice(common)]
            if rng.random() < 0.5:
                t.insert(at, own[2])
        elif rng.random() < 0.3:
            t.insert(0, rng.choice([o[2] for o in people.values()]))
        texts.append(" ".join(t))
    texts += [texts[1]] * 30 + ["a 10.1.2.3 only once beside Lonely words"] * 5
    want = disclosing(texts)
    assert 6 <= len(want) < 25 and "lonely" not in want
    got = {r["doc_id"]: r for r in pii.detected(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        base = base_spans(t)
        spots = []
        for m in WORD.finditer(t):
            w = m.group()
            core = w.strip(pii._MARKS)
            a = m.start() + len(w) - len(w.lstrip(pii._MARKS))
            if core.lower() in want and not any(s < a + len(core) and a < e for _, s, e, _ in base):
                spots.append((a, a + len(core), want[core.lower()]))
        assert got[i]["spans"].split(",") == [x for x in [*(f"{k}:{s}:{e}" for k, s, e, _ in base), *(f"term:{a}:{b}" for a, b, _ in spots)]] or not base and not spots and not got[i]["spans"]
        out, at = "", 0
        for s, e, put in sorted([*((s, e, f"[{k.upper()}]") for k, s, e, _ in base), *((a, b, "" if p > pii.REMOVE else "[TERM]") for a, b, p in spots)]):
            out, at = out + t[at:s] + put, e
        assert clean[i] == out + t[at:]


def test_pii_rows_keep_their_own_spans(spark, empty):
    told = [(0, f"filler{i} Zebrafish boss@corp.com other{i * 7}") for i in range(8)]
    rows = [*told, (0, "words nobody should cut"), (None, "mail a@b.cd now"), (None, "nothing to see"), (-(1 << 63), "x a@b.cd"), (1, None), (1, ""), (2, "Zebrafish " * 3 + "y" * 100 + " " + "z" * 90_000), (2, "Zebrafish " * 3 + "y" * 100 + " " + "z" * 90_000)]
    docs = clashing(spark, rows)
    out = pii.sanitised(docs)
    assert out.columns == docs.columns and all(r["id"] == "own id" and r["found"] == "own found" for r in out.collect())
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    mend = lambda t: None if t is None else re.sub("Zebrafish", "[TERM]", re.sub(r"\S+@\S+", "[EMAIL]", t))
    assert got == sorted(((i, mend(t)) for i, t in rows), key=str)
    seen = pii.detected(docs)
    assert sorted((r["n_email"] for r in seen.collect()), reverse=True) == [1] * 10 + [0] * 6 and seen.where(F.col("doc_id") == -(1 << 63)).count() == 1
    assert pii.sanitised(empty).columns == empty.columns and pii.sanitised(empty).count() == 0


# 4, 1
def test_rows_that_share_an_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(25)) for x in "ab")
    rows = [(1, a), (1, a), (2, a), (None, b), (3, f"{b} tail"), (4, None), (4, "")]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.deduplicated(clashing(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 25, 0), (1, 25, 0), (2, 25, 25), (None, 25, 0), (3, 26, 25), (4, 0, 0), (4, 0, 0)], key=str)
    drawn = pieces.sampled(clashing(spark, rows), SP).collect()
    assert len(drawn) == 12 and len({(r["doc_id"], r["sample"], tuple(r["ids"])) for r in drawn if r["doc_id"] == 1}) == 2
    assert {r["sample"] for r in drawn if r["doc_id"] == 4} == {1} and sum(r["doc_id"] is None for r in drawn) == 2


# 5
def test_sharding_keeps_clashing_columns_in_mind(spark):
    docs = clashing(spark, [(1, "a"), (1, "a"), (None, None)])
    out = sharding.place(docs)
    assert out.count() == 3 and set(out.columns) == set(docs.columns) and all(r["id"] == "own id" and r["shard"].startswith("shard-") for r in out.collect())


# 6, 10
def test_scores_don_t_depend_on_neighbours(spark):
    """Repeated rows, null ids and texts, very long texts, other partitions: equal texts have equal scores."""
    rng = random.Random(1)
    every = ["", "short", "x" * 23, "x" * 24, "aa aa " * 500, " ".join(rng.choice(["red", "bad", "tree"]) for _ in range(100_000)), None]
    rows = [(i % 4 or None, t) for i, t in enumerate(every * 3)]
    net = quality.fit(pa.table({"text": ["red tree " * 5, "bad bad " * 9] * 40, "label": [1, 0] * 40}))
    chain = toxicity.fit_table(pa.table({"text": ["red tree", "bad red"] * 40, "label": [0, 1] * 40}))
    for run, col in ((lambda d: quality.scored(d, net), "score"), (lambda d: toxicity.scored(d, chain), "p_toxic")):
        got = []
        for parts in (1, 5):
            docs = clashing(spark, rows, parts).sortWithinPartitions(F.rand(3))
            got.append(sorted(((str(r["doc_id"]), r[col]) for r in run(docs).collect())))
        assert len(got[0]) == len(rows) and np.allclose([g[1] for g in got[0]], [g[1] for g in got[1]], atol=1e-6)
        assert len({round(g[1], 5) for g in got[0]}) <= len(every)
    dotted = clashing(spark, rows).withColumn("a.dot", F.lit(7))
    kept = quality.accepted(dotted, net)
    assert kept.columns == dotted.columns and kept.columns[2:-1] == CLASH.split() and all(r["a.dot"] == 7 for r in kept.collect())


# 7
def test_embeddings_with_repeated_ids(spark):
    v, w = [1.0] * 8, [1.0, -1.0] * 4
    rows = [(1, v), (1, v), (1, w), (None, v), (None, w), (2, w), (-(1 << 63), [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("raw", F.lit("own"))
    got = embeddings.linked(df).collect()
    assert len(got) == 7 and sorted(r["n_links"] for r in got) == [0, 2, 2, 2, 2, 2, 2]


# 9
def brute(rows, n=2, threshold=80):
    """Component (smallest id, a null one below all) of each row."""
    sets = [shingles(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = lambda i: -(1 << 70) if i is None else i
    least = defaultdict(lambda: 1 << 70)
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], low(d))
    return [(d, len(sets[i]), None if least[find(i)] == -(1 << 70) else least[find(i)], low(d) == least[find(i)]) for i, (d, _) in enumerate(rows)]


def family(rng, n, size=60, most=9):
    base = [f"t{i}" for i in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, most)):
            w[rng.randrange(size)] = f"u{rng.randrange(50)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("most", [200_000, 0])
def test_deduplicated_repeated_and_null_ids(spark, monkeypatch, most):
    monkeypatch.setattr(runtime, "BROADCAST_KEYS", most)
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(3, b), (7, a), (7, b), (7, b), (None, a), (None, "alone here now"), (None, "alone here now"), (9, None), (9, None), (9, ""), (-5, a + " tail")]
    kept = neardup.deduplicated(clashing(spark, rows))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(3, b), (None, a), (None, "alone here now"), (9, None), (9, "")], key=str)
    unique = [(i, t) for i, (_, t) in enumerate(rows)]
    assert sorted(r["doc_id"] for r in neardup.deduplicated(clashing(spark, unique)).collect()) == [0, 1, 5, 7, 8, 9]


def test_neardup_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(3, b), (7, a), (7, b), (7, b), (8, c), (None, c), (None, a), (None, "alone here now"), (9, None), (9, ""), (10, "one"), (11, "ONE"), (-5, a + " tail"), (12, "w " * 30_000), (13, "w " * 20_000)]
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(clashing(spark, rows)).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


@pytest.mark.parametrize("rounds", [0, 1, 2])
def test_neardup_blocks(spark, rounds, monkeypatch):
    """Families that stars don't settle: small blocks, copied for many probes; many keys go through the filter."""
    monkeypatch.setattr(runtime, "BROADCAST_KEYS", (200_000, 0, 30)[rounds])
    rng = random.Random(rounds)
    rows = [(i, t) for i, t in enumerate([*family(rng, 70), *family(rng, 40, 30, 5), *(f"other {i} words {i * i}" for i in range(20))])]
    old = neardup.MOST_BLOCK, neardup.STAR_ROUNDS
    neardup.MOST_BLOCK, neardup.STAR_ROUNDS = 4, max(1, rounds)
    try:
        got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(clashing(spark, rows, 5)).collect())
    finally:
        neardup.MOST_BLOCK, neardup.STAR_ROUNDS = old
    assert got == sorted(brute(rows))


def test_neardup_recall_at_the_threshold():
    """Pairs of a similarity of 0.80 exactly: how many share a table."""
    rng = np.random.default_rng(2)
    n = 3000
    shared = rng.integers(1, 2**63, (n, 80), dtype=np.uint64)
    one, two = (np.concatenate([shared, rng.integers(1, 2**63, (n, 10), dtype=np.uint64)], 1) for _ in range(2))
    half = neardup.HALVES
    a, b = (neardup.sketches(words.mix64(x).ravel(), np.arange(n + 1) * 90) for x in (one, two))
    met = (a[:, :half] == b[:, :half]).any(1) & (a[:, half:] == b[:, half:]).any(1)
    assert met.mean() > 0.998


# pipeline
def test_stages_with_hard_rows(spark, tmp_path, corpus, empty):
    """Each stage on null and repeated ids, null, empty and very long texts, repeated rows, clashing names; and on an empty table."""
    d = str(tmp_path)
    spark.createDataFrame([(600 + i, 1 - i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    passage = corpus[-1][1].split()[:33]
    spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    rows = [(600 + i, " ".join(("GO!! STOP!! NOW!!" if i % 2 else f"a calm river {i} walks by the {i * i} stone").split() * 9)) for i in range(60)]
    rows += [(None, "a calm river walks by"), (None, "another river walks"), (7, "a calm stone and a bird"), (7, "a calm stone and a bird"), (7, "me@x.org walks by a calm river with the bird")]
    rows += [(8, None), (8, ""), (9, " ".join(f"river{i} walks" for i in range(40_000))), (None, " ".join(["x", *passage, "y"])), (10, " ".join(passage))]
    docs = clashing(spark, rows).withColumn("n_chars", F.length("text").cast("long"))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        assert all(r["id"] == "own id" for r in docs.select("id").collect())
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    texts = [t for _, t in left]
    assert texts.count("a calm stone and a bird") == 1 and not any(t and passage[5] + " " + passage[6] in t for t in texts) and (9, rows[-3][1]) in left
    assert not any("@" in (t or "") for t in texts) and any("[EMAIL] walks" in (t or "") for t in texts)
    assert all((r["n_chars"] == len(r["text"])) if r["text"] is not None else r["n_chars"] is None for r in docs.collect())
    enc = P.pieces_stage(spark, docs, d)
    assert enc.where("sample = 1").count() == len(left) and enc.where("NOT decoded").count() == 0
    for name, stage in P.STAGES:
        assert stage(spark, empty, d).count() == 0, name


def test_pipeline_by_brute_force(spark, tmp_path, corpus):
    """What run() returns, beside plain versions of all stages but the network, whose decisions are checked against its own scores."""
    d, rng = str(tmp_path), random.Random(21)
    passage = " ".join(f"item{i}" for i in range(24))
    rows = [(i, t) for i, t in corpus if t]
    rows += [(2000 + i, t) for i, t in enumerate([*family(rng, 40, 80, 4), *family(rng, 30, 40, 8)])]
    rows += [(3000 + i, f"{rng.choice(corpus)[1] or 'x'} {passage if i % 2 else passage[:60]} end") for i in range(8)]
    rows += [(4000 + i, f"write to person{i}@host{i}.org or call +49 170 55{i:05d} from 10.0.{i}.1 please number {i} " + " ".join(f"q{i}w{j}" for j in range(30))) for i in range(12)]
    rows += [(600 + i, " ".join(("GO!! STOP!! NOW!!" if i % 2 else f"calm river {i} walks").split() * 9)) for i in range(60)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(600 + i, 1 - i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, "no such words in any of them here")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    net = quality.train(docs, spark.read.parquet(f"{d}/labels.parquet"))
    good = {r["doc_id"] for r in quality.scored(docs, net).where("score >= 0.3").select("doc_id").collect()}
    assert {r["doc_id"] for r in P.quality_stage(spark, docs, d).collect()} == good and 40 < len(good) < len(rows)
    left = [(i, t) for i, t in rows if i in good]
    left = [r for r, (_, _, _, kept) in zip(left, brute(left, 5)) if kept]
    items = [shingles(passage), shingles("no such words in any of them here")]
    left = [(i, t) for i, t in left if not any(len(q & shingles(t)) >= 0.8 * len(q) for q in items)]

    def clean(t):
        found = [(m.start(), m.end(), "[EMAIL]") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        found += [(m.start(), m.end(), "[IP]") for m in re.finditer(r"[0-9]+(\.[0-9]+){3}", t)]
        found += [(m.start(), m.end(), "[PHONE]") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        out, at = "", 0
        for s, e, put in sorted(found):
            out, at = out + t[at:s] + put, e
        return out + t[at:]

    want = {i: clean(t) for i, t in left}
    out = P.run(spark, d).cache()
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == set(want) and 30 < len(want) < len(good)
    for rank in (1, 2):
        assert {r["doc_id"]: r["text"] for r in pieces.decoded(out.where(f"sample = {rank}"), SP).collect()} == want
    assert any("[PHONE] from [IP]" in t for t in want.values())


def test_sanitised_texts_have_no_sha_left(spark):
    assert hashlib.sha256(b"").hexdigest() == pii.detected(spark.createDataFrame([(1, None)], "doc_id long, text string")).first()["base_sha256"]


# 7
def test_embeddings_disk(spark, tmp_path):
    """All that a run writes stays below three times the vectors; waves and a sample for large buckets change no link."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12_000, 64)).astype(np.float32)
    base[6000:] = base[:6000] + rng.normal(size=(6000, 64)).astype(np.float32) * 0.15
    pq.write_table(pa.table({"vec_id": np.arange(len(base)), "embedding": pa.array(list(base), pa.list_(pa.float32()))}), tmp_path / "e.parquet")
    rows = spark.read.parquet(str(tmp_path / "e.parquet"))
    sent, whole, old = [], embeddings.written, (embeddings.WAVE_BYTES, embeddings.SAMPLED, embeddings.MOST_WAVES)

    def wrote(df, name, **how):
        out = whole(df, name, **how)
        sent.append((name, sum(p.stat().st_size for p in Path(out._quillspan_path.removeprefix("file:")).rglob("*.parquet"))))
        return out

    got = []
    embeddings.written = wrote
    try:
        for embeddings.WAVE_BYTES, embeddings.SAMPLED, embeddings.MOST_WAVES in ((1 << 40, 1 << 16, 48), (1 << 22, 100, 5)):
            sent.clear()
            got.append(sorted(map(tuple, embeddings.linked(rows).collect())))
            assert sum(n for _, n in sent) < 3 * base.nbytes
    finally:
        embeddings.written, (embeddings.WAVE_BYTES, embeddings.SAMPLED, embeddings.MOST_WAVES) = whole, old
    assert got[0] == got[1] and sum(name == "links" for name, _ in sent) >= 5
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    assert sum(r[1] for r in got[0]) == 2 * sum(((unit[i : i + 500] @ unit[: i + 500].T >= 0.95) & (np.arange(i + 500)[None, :] < np.arange(i, i + 500)[:, None])).sum() for i in range(0, 12_000, 500)) > 9000
