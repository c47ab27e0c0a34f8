"""Operator 1: words that end alike share the nodes of their common end, and no sample changes by it."""

import numpy as np
import public_tokenizers
import pytest

from quillspan.llm import pieces

SP = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture
def v(monkeypatch):
    monkeypatch.setattr(pieces, "_LATTICES", {})
    return pieces.vocabulary(SP)


def root(lat, word: bytes) -> int:
    return int(lat.roots(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0])


def segmentations(lat, node: int) -> dict[tuple, float]:
    if node == 0:
        return {(): 0.0}
    return {(int(lat.id[e]), *rest): float(lat.log_q[e]) + x for e in range(lat.first[node], lat.first[node + 1]) for rest, x in segmentations(lat, int(lat.target[e])).items()}


def brute(v, word: bytes) -> dict[tuple, float]:
    by = {v.bytes[i]: (int(i), w) for i, w in zip(v.id, v.weight)}

    def every(b):
        if not b:
            return {(): 0.0}
        return {(by[b[:n]][0], *rest): by[b[:n]][1] + x for n in range(1, len(b) + 1) if b[:n] in by for rest, x in every(b[n:]).items()}

    out = every(word)
    total = np.logaddexp.reduce(list(out.values()))
    return {k: w - total for k, w in out.items()}


def drawn(v, texts: list[bytes], k: int = 3):
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    s = pieces.Sampler(v, np.frombuffer(b"".join(texts), np.uint8), offsets, pieces.mix64(np.arange(len(texts), dtype=np.uint64)))
    return [[(s.ids([e], np.array([d]))[0].tolist(), round(lp, 9), round(value, 9)) for e, lp, value in found] for d, found in enumerate(s.run(k))], np.round(s.kappa, 9).tolist()


def test_words_that_end_alike_share_nodes(v):
    lat = pieces.Lattices(v)
    root(lat, b" station")
    before = len(lat.first)
    node = root(lat, b" nation")
    assert len(lat.first) - before == 2  # " nation" and "nation"; seven before ends were shared
    assert root(lat, b"ation") and len(lat.first) - before == 2
    for word, at in ((b" nation", node), (b" station", root(lat, b" station")), (b"ation", root(lat, b"ation"))):
        got, want = segmentations(lat, at), brute(v, word)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_nodes_that_are_lost_are_learned_again(v, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join("".join(rng.choice(["tion", "ing", "er", "é", "日", "\n", "a"], rng.integers(1, 9))) for _ in range(30)).encode() for _ in range(40)]
    texts[7] = b""
    want = drawn(v, texts)
    known = pieces.Lattices._known
    monkeypatch.setattr(pieces.Lattices, "_known", lambda self, h: np.where(rng.random(len(h)) < 0.5, known(self, h), 0))
    monkeypatch.setattr(pieces, "_LATTICES", {})
    assert drawn(v, texts) == want
    monkeypatch.setattr(pieces, "MOST_EDGES", 1)
    assert drawn(v, texts[:20])[0] == want[0][:20] and drawn(v, texts[:20]) == drawn(v, texts[:20])


def test_equal_hashes_meet(v):
    rng = np.random.default_rng(5)
    for h in (np.zeros(0, np.uint64), np.full(50, 7, np.uint64), rng.integers(0, 300, 5000).astype(np.uint64), pieces.mix64(rng.integers(0, 3000, 5000).astype(np.uint64))):
        at = pieces.alike(h)
        assert (h[at] == h).all() and len(np.unique(at)) == len(np.unique(h))


def test_long_words_are_hashed_in_linear_time(v, monkeypatch):
    hashed, plain = [], pieces.byte_hashes
    monkeypatch.setattr(pieces, "byte_hashes", lambda data, lo, hi: hashed.append(int((hi - lo).sum())) or plain(data, lo, hi))
    text = "".join(np.random.default_rng(6).choice(list("abcdé"), 20_000)).encode()
    got, _ = drawn(v, [text], 2)
    assert sum(hashed) < 3 * len(text) and all(v.decode(ids) == text for ids, _, _ in got[0])


def test_an_id_that_spells_nothing_is_not_decoded(v):
    """A model without byte pieces gives no id for a character that it lacks."""
    s = pieces.Sampler(v, np.frombuffer(b"a\na", np.uint8), np.array([0, 1, 3]), np.zeros(2, np.uint64))
    ids = np.array([v.model.piece_to_id("▁a"), v.model.piece_to_id("▁"), -1, v.model.piece_to_id("a")], np.int32)
    assert s.spelled(ids, np.array([1, 3]), np.arange(2)).tolist() == [True, False]
    assert s.spelled(ids[:0], np.array([0]), np.array([0])).tolist() == [False]
