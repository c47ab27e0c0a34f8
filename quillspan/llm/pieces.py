"""SentencePiece encoding and decoding with Gumbel top-k sampling.

A text's lattice has a node at each character and an edge for each piece of
the vocabulary; a character that is no piece has one edge of its byte pieces.
A path is a segmentation, and its probability is proportional to the product
of its pieces' weights. Models with log probabilities (unigram) give these as
weights; a merge model stores ranks instead, which count by Zipf's law.

Sampling is an A* search over perturbed log-probabilities. Adding independent
Gumbel noise to all paths and taking the k best draws k distinct paths without
replacement. The search never lists paths: a region is a set of paths that
share a prefix and avoid some next edges; its best perturbed value is one
truncated Gumbel draw around the region's log mass, which backward sums over
the lattice give exactly. The region with the highest value yields the next
path (a forward draw within the region) and splits into the regions beside that
path, bounded by its value. The value of the best region left, kappa, gives each
path's inclusion score 1 - exp(-exp(log_prob - kappa)), kept as a logarithm.

All draws are hashes of the row key and the place of the decision, so a row's
sample doesn't depend on its neighbours, the partitioning or a retry.

No piece goes beyond a word with the spaces before it, so each distinct word
gets its lattice once, kept for the texts that follow in a store of bounded
size, and all words advance together. What follows a node depends on the rest of
its word alone, so words that end alike share the nodes of their common end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.runtime import keep_memory, mapped, mix64, ship
from quillspan.llm.words import _BYTE, _R, byte_hashes, powers, texts

SAMPLES, TEMPERATURE, SLICE_BYTES = 2, 1.0, 180_000
#: Edges of lattices that a process keeps (32 bytes each, and 24 a node); beyond it the store starts anew.
MOST_EDGES = 1_000_000
#: Ends of words up to so many bytes share their nodes; of longer ones only whole words do, so hashing stays linear in a word's length.
SHARED_BYTES = 24
#: An edge's fields lie side by side: a draw touches one line of memory.
_EDGE = np.dtype([("cum", np.float64), ("log_q", np.float64), ("source", np.int32), ("size", np.int32), ("id", np.int32), ("target", np.int32)])
_BITS = 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def uniform(key: np.ndarray, place: np.ndarray, draw: int) -> np.ndarray:
    """Uniform numbers in (0, 1) from row key, place in the text and number of the draw."""
    h = mix64(key + mix64(place.astype(np.uint64) * _GOLD + np.uint64(draw)))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def truncated(mass: np.ndarray, u: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Gumbel draws around the log ``mass`` that don't exceed ``most``; -inf for an empty region."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        out = mass - np.log(np.exp(mass - most) - np.log(u))
    return np.where(np.isneginf(mass), -np.inf, np.minimum(out, most))


class Vocabulary:
    """Pieces of a model as byte strings, with log weights and a hash table."""

    def __init__(self, path: str, temperature: float = TEMPERATURE):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.model.get_piece_size()
        scores = np.array([self.model.get_score(i) for i in range(n)])
        self.bytes, self.byte_id = [b""] * n, np.full(256, -1)
        usable = np.zeros(n, bool)
        for i in range(n):
            if self.model.is_byte(i):
                value = int(self.model.id_to_piece(i)[3:5], 16)
                self.bytes[i], self.byte_id[value] = bytes([value]), i
            elif not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i)):
                self.bytes[i] = self.model.id_to_piece(i).replace("▁", " ").encode()
                usable[i] = True
        self.inner_space = any(b" " in p.lstrip(b" ") for p, u in zip(self.bytes, usable) if u)
        ids = np.flatnonzero(usable)
        ranks = (scores[ids] == np.rint(scores[ids])).all()
        weight = -np.log(np.clip(-scores[ids], 0, n) + 2.7) if ranks else scores[ids]
        self.byte_weight = (weight.min() - 1.0) / temperature
        size = np.array([len(self.bytes[i]) for i in ids])
        flat = np.frombuffer(b"".join(self.bytes[i] for i in ids), np.uint8)
        end = np.cumsum(size)
        pw, inv = powers(_R, len(flat) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[flat] * pw[:-1])])
        h = (sums[end] - sums[end - size]) * inv[end - size] + size.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        self.hash, self.id, self.weight = h, ids.astype(np.int32), weight / temperature
        # a piece stands at the first slot that its hash gives, or where that is taken at the second; a few, if both are, in a sorted list
        slots = (h * _GOLD >> np.uint64(64 - _BITS)).astype(np.int64)
        self.slot = np.full(1 << _BITS, -1, np.int32)
        self.slot[slots[::-1]] = np.arange(len(h))[::-1]
        late = np.flatnonzero(self.slot[slots] != np.arange(len(h)))
        late = late[np.argsort(h[late])]
        self.late_hash, self.late = h[late], late.astype(np.int32)
        self.crowded = np.zeros(1 << _BITS, bool)
        self.crowded[slots[late]] = True
        self.lengths = np.unique(size)
        self.size = np.array([len(b) for b in self.bytes])
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.spelling = pa.array(self.bytes, pa.binary())

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes are pieces, and the pieces' places."""
        slots = (h * _GOLD >> np.uint64(64 - _BITS)).astype(np.int64)
        at = self.slot[slots]
        maybe = np.flatnonzero(at >= 0)
        at, own = at[maybe], h[maybe]
        hit = self.hash[at] == own
        if len(self.late):
            other = np.flatnonzero(~hit & self.crowded[slots[maybe]])
            k = np.minimum(np.searchsorted(self.late_hash, own[other]), len(self.late) - 1)
            there = self.late_hash[k] == own[other]
            at[other[there]] = self.late[k[there]]
            hit[other[there]] = True
        return maybe[hit], at[hit]

    def encode(self, text: str) -> list[int]:
        """The model's best ids. U+2581, which the model takes for a space, goes as its bytes: it travels as a private character that the text doesn't hold."""
        if "\u2581" not in text:
            return self.model.encode(text)
        other = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in text and self.model.piece_to_id(c) == self.model.unk_id())
        put, own = ([int(self.byte_id[x]) for x in c.encode()] for c in (other, "\u2581"))
        ids = self.model.encode(text.replace("\u2581", other))
        for i in range(len(ids) - 2):
            if ids[i : i + 3] == put:
                ids[i : i + 3] = own
        return ids

    def decode(self, ids: np.ndarray) -> bytes:
        """Text of ids: bytes of all pieces without the space put before the text."""
        ids = np.asarray(ids, np.int64)
        size = self.size[ids]
        last = np.cumsum(size)
        raw = self.flat[np.repeat(self.start[ids] - (last - size), size) + np.arange(last[-1])] if len(ids) else self.flat[:0]
        return raw[1:].tobytes()


class Grown:
    """An array that takes more at its end."""

    def __init__(self, dtype):
        self.whole, self.n = np.empty(1 << 12, dtype), 0

    def room(self, n: int) -> np.ndarray:
        """``n`` more at the end, to be filled."""
        if self.n + n > len(self.whole):
            old, self.whole = self.whole, np.empty(max(2 * len(self.whole), self.n + n), self.whole.dtype)
            self.whole[: self.n] = old[: self.n]
        self.n += n
        return self.whole[self.n - n : self.n]

    @property
    def now(self) -> np.ndarray:
        return self.whole[: self.n]


def alike(h: np.ndarray) -> np.ndarray:
    """For each hash the place of one that is equal to it, the same for all that are equal: each round the hashes that hold a slot of a table are settled."""
    out, open_, factor = np.empty(len(h), np.int64), np.arange(len(h)), int(_GOLD)
    while len(open_):
        own, bits = h[open_], (4 * len(open_)).bit_length()
        slots = (own * np.uint64(factor) >> np.uint64(64 - bits)).astype(np.int64)
        table = np.zeros(1 << bits, np.int64)
        table[slots] = open_
        holder = table[slots]
        same = h[holder] == own
        out[open_[same]] = holder[same]
        open_, factor = open_[~same], factor * 0xD1342543DE82EF95 + 2 & (1 << 64) - 1 | 1
    return out


class Lattices:
    """Lattices of distinct words, their nodes kept by the hash of what is left of the word. An edge of a node leads to another node, or to node 0 at the word's end.

    A node is found at the slot that its hash gives or at that one's neighbour.
    One whose slots others have taken is learned again when it is met, which
    changes no result.
    """

    def __init__(self, v: Vocabulary):
        self.v = v
        self._first, self._hash, self._beta, self._edge = Grown(np.int64), Grown(np.uint64), Grown(np.float64), Grown(_EDGE)
        self.slot = np.empty(1 << _BITS, np.int32)
        self._reset()

    def _reset(self) -> None:
        self.slot[:] = 0
        for g in (self._first, self._hash, self._beta, self._edge):
            g.n = 0
        self._first.room(2)[:], self._hash.room(1)[:], self._beta.room(1)[:] = 0, 0, 0.0
        self._see()

    def _see(self) -> None:
        self.first, self.hash, self.beta, edge = self._first.now, self._hash.now, self._beta.now, self._edge.now
        for k in _EDGE.names:
            setattr(self, k, edge[k])

    def _known(self, h: np.ndarray) -> np.ndarray:
        """Nodes of hashes, 0 for those not kept."""
        slots = (h >> np.uint64(64 - _BITS)).astype(np.int64)
        out = self.slot[slots].astype(np.int64)
        other = np.flatnonzero(self.hash[out] != h)
        beside = self.slot[slots[other] ^ 1]
        out[other] = np.where(self.hash[beside] == h[other], beside, 0)
        return out

    def _keep(self, h: np.ndarray, nodes: np.ndarray) -> None:
        slots = (h >> np.uint64(64 - _BITS)).astype(np.int64)
        self.slot[np.where(self.slot[slots] == 0, slots, slots ^ 1)] = nodes

    def roots(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """First node of each word ``data[start:end]``; words not seen before get their lattices."""
        if len(self.source) > MOST_EDGES:
            self._reset()
        hashes = byte_hashes(data, start, end)
        out = self._known(hashes)
        new = np.flatnonzero(out == 0)
        if len(new):
            one = alike(hashes[new])
            own = np.flatnonzero(one == np.arange(len(new)))
            begin, size = start[new[own]], (end - start)[new[own]]
            stop = np.cumsum(size)
            flat = data[np.repeat(begin - (stop - size), size) + np.arange(stop[-1])]
            learned = np.zeros(len(new), np.int64)
            learned[own] = self._learn(flat, stop - size, stop)
            out[new] = learned[one]
        return out

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Append what the lattices of words lack, nodes in the order of their distance to the word's end; the words' first nodes."""
        v, n, before = self.v, len(data), len(self.first) - 1
        left = np.repeat(end, end - start) - np.arange(n)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        far = left[at]
        shared = far <= SHARED_BYTES
        shared[np.searchsorted(at, start)] = True
        own = np.flatnonzero(shared)
        h = byte_hashes(data, at[own], at[own] + far[own])
        node = np.zeros(n + 1, np.int32)
        known = self._known(h)
        node[at[own]] = known
        new = np.flatnonzero(known == 0)
        own, h = own[new], h[new]
        one = alike(h)
        first_of = one == np.arange(len(one))
        twin, model = at[own[~first_of]], at[own[one[~first_of]]]
        learn = ~shared
        learn[own[first_of]] = True
        hashes = np.zeros(len(at), np.uint64)
        hashes[own] = h
        hashes, kept, at, far = hashes[learn], shared[learn], at[learn], far[learn]
        order = np.argsort(far.astype(np.uint16) if len(far) and far.max() < 1 << 16 else far, kind="stable")
        hashes, kept, at, far = hashes[order], kept[order], at[order], far[order]
        many = len(at)
        node[at] = np.arange(before, before + many)
        node[twin] = node[model]
        self._hash.room(many)[:] = hashes
        self._keep(hashes[kept], node[at[kept]])

        pw, inv = powers(_R, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * pw[:n], out=sums[1:])
        lead = data[at]
        width = 1 + (lead >= 0xC0).astype(np.int32) + (lead >= 0xE0) + (lead >= 0xF0)
        begun, scale = sums[at], inv[at]
        hits: list[tuple[np.ndarray, int, np.ndarray]] = []
        single, degree = np.zeros(many, bool), np.zeros(many, np.int32)
        for size, lo in zip(v.lengths.tolist(), np.searchsorted(far, v.lengths).tolist()):
            if lo == many:
                break
            k, pos = v.find((sums[at[lo:] + size] - begun[lo:]) * scale[lo:] + np.uint64(size * 0xD1342543DE82EF95 & (1 << 64) - 1))
            k += lo
            if size <= 4:
                single[k[width[k] == size]] = True
            degree[k] += 1
            hits.append((k, size, pos))
        bare = np.flatnonzero(~single)
        degree[bare] += 1
        first = np.concatenate([[0], np.cumsum(degree)]).astype(np.int64)
        edges, edges_before = int(first[-1]), len(self.source)
        sizes, ids, weights = np.empty(edges, np.int32), np.empty(edges, np.int32), np.empty(edges)
        slot = first[:-1].copy()
        for k, size, pos in hits[::-1]:  # long pieces first: likelier, so found sooner by draw()
            e = slot[k]
            slot[k] += 1
            sizes[e], ids[e], weights[e] = size, v.id[pos], v.weight[pos]
        e = slot[bare]
        sizes[e], ids[e], weights[e] = np.minimum(width[bare], far[bare]), -1, v.byte_weight * width[bare]
        source = np.repeat(np.arange(many), degree)
        beyond = at[source] + sizes
        target = np.where(far[source] == sizes, 0, node[beyond])
        self._beta.room(many)[:] = 0.0
        beta, through = self._beta.now, weights
        cut = np.concatenate([[0], np.flatnonzero(far[1:] != far[:-1]) + 1, [many]])
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
            lo, hi = first[s], first[e]
            through[lo:hi] += beta[target[lo:hi]]
            beta[before + s : before + e] = np.logaddexp.reduceat(through[lo:hi], first[s:e] - lo)
        log_q = np.minimum(through - np.repeat(beta[before:], degree), 0.0)
        log_q[first[:-1][degree == 1]] = 0.0
        q = np.exp(log_q)
        total = np.cumsum(q)
        cum = source + np.minimum(total - np.repeat((total - q)[first[:-1]], degree), 1.0)
        cum[first[1:] - 1] = np.arange(many) + 1.0
        self._first.room(many)[:] = first[1:] + edges_before
        edge = self._edge.room(edges)
        edge["cum"], edge["log_q"], edge["source"], edge["size"], edge["id"], edge["target"] = cum + before, log_q, source + before, sizes, ids, target
        self._see()
        return node[start].astype(np.int64)

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge out of each node, by conditional probability."""
        e, want = self.first[node], node + u
        open_ = np.flatnonzero(self.cum[e] <= want)
        while len(open_):
            e[open_] += 1
            open_ = open_[self.cum[e[open_]] <= want[open_]]
        return e

    def draw_other(self, node: np.ndarray, u: np.ndarray, out: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Of each node one of the edges that are not in its ``out``, by conditional probability, and the log probability of those then left."""
        lo, degree = self.first[node], self.first[node + 1] - self.first[node]
        place = np.arange(int(degree.max()))
        edges = lo[:, None] + place
        inside = place < degree[:, None]
        log_q = np.where(inside, self.log_q[np.where(inside, edges, lo[:, None])], -np.inf)
        row = np.repeat(np.arange(len(node)), [len(x) for x in out])
        log_q[row, np.concatenate([np.array(x, np.int64) for x in out]) - lo[row]] = -np.inf
        total = np.cumsum(np.exp(log_q - log_q.max(1, keepdims=True)), axis=1)
        last = len(place) - 1 - np.isfinite(log_q[:, ::-1]).argmax(1)
        new = np.minimum((total <= (u * total[:, -1])[:, None]).sum(1), last)
        log_q[np.arange(len(node)), new] = -np.inf
        return lo + new, np.logaddexp.reduce(log_q, axis=1)


def _spread(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space put before each that isn't empty."""
    size = np.diff(offsets)
    put = offsets[:-1][size > 0]
    return np.insert(data, put, 32), offsets + np.concatenate([[0], np.cumsum(size > 0)])


class Sampler:
    """The ``k`` sampled segmentations of each text of one slice."""

    def __init__(self, v: Vocabulary, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray):
        self.v = v
        self.data, self.offsets = _spread(data, offsets)
        n, data = len(self.data), self.data
        self.keys, self.docs = keys, len(offsets) - 1
        self.doc = np.repeat(np.arange(self.docs), np.diff(self.offsets))
        edge = np.zeros(n + 1, bool)
        if not v.inner_space:
            edge[1:n] = (data[1:] == 32) & (data[:-1] != 32)
        edge[self.offsets] = True
        edge[n] = False
        self.word = np.flatnonzero(edge)
        end = np.append(self.word[1:], n) if n else self.word
        self.lattice = lattices(v)
        self.root = self.lattice.roots(data, self.word, end) if n else self.word

    def _walk(self, edge_at: np.ndarray, at: np.ndarray, node: np.ndarray, draw: int) -> None:
        """Draw on from (place, node) to the end of each word."""
        lat = self.lattice
        while len(at):
            e = lat.draw(node, uniform(self.keys[self.doc[at]], at - self.offsets[self.doc[at]], draw))
            edge_at[at] = e
            at, node = at + lat.size[e], lat.target[e]
            on = node > 0
            at, node = at[on], node[on]

    def _regions(self, edge_at: np.ndarray, since: np.ndarray, most: np.ndarray, draw: int) -> dict:
        """Decisions of a path, and the regions beside those at or after ``since`` (a place for each text)."""
        at = np.flatnonzero(edge_at >= 0)
        e, doc = edge_at[at], self.doc[at]
        log_q = self.lattice.log_q[e]
        cut = np.searchsorted(at, self.offsets)
        run = np.concatenate([[0.0], np.cumsum(log_q)])
        before = run[:-1] - run[cut[:-1]][doc]
        value = np.full(len(at), -np.inf)
        open_ = np.flatnonzero((log_q < 0) & (at >= since[doc]))
        own = doc[open_]
        mass = before[open_] + np.log(-np.expm1(log_q[open_]))
        value[open_] = truncated(mass, uniform(self.keys[own], at[open_] - self.offsets[own], draw), most[own])
        return {"edge_at": edge_at, "at": at, "doc": doc, "cut": cut, "before": before, "value": value, "total": run[cut[1:]] - run[cut[:-1]], "out": {}}

    def run(self, k: int) -> list[list[tuple[np.ndarray, float, float]]]:
        """Per text the paths in order of their perturbed values: (edges' places, log probability, value); and kappa in ``self.kappa``."""
        found: list[list] = [[] for _ in range(self.docs)]
        lat = self.lattice
        self.kappa = np.full(self.docs, -np.inf)
        empty = np.diff(self.offsets) == 0
        for d in np.flatnonzero(empty):
            found[d].append((np.zeros(0, np.int64), 0.0, 0.0))
        if not len(self.data):
            return found
        zero = np.zeros(self.docs, np.int64)
        top = -np.log(-np.log(uniform(self.keys, zero, 1)))
        path = np.full(len(self.data), -1, np.int32)
        self._walk(path, self.word, self.root, 2)
        leaves = [self._regions(path, zero, top, 3)]
        for d in np.flatnonzero(~empty):
            a, b = leaves[0]["cut"][d : d + 2]
            found[d].append((path[leaves[0]["at"][a:b]], float(leaves[0]["total"][d]), float(top[d])))
        for turn in range(1, k + 1):
            best, which = np.full(self.docs, -np.inf), zero.copy()
            for i, leaf in enumerate(leaves):
                c = leaf["cut"]
                some = np.flatnonzero(c[1:] > c[:-1])
                value = np.maximum.reduceat(leaf["value"], c[:-1][some])
                better = value > best[some]
                best[some[better]], which[some[better]] = value[better], i
            live = np.flatnonzero(np.isfinite(best))
            if turn == k:
                self.kappa = best
                break
            path = np.full(len(self.data), -1, np.int32)
            since, starts, nodes = np.full(self.docs, 1 << 60), [], []
            for i, leaf in enumerate(leaves):
                of = live[which[live] == i]
                if not len(of):
                    continue
                goal = np.full(self.docs, np.inf)
                goal[of] = best[of]
                top = np.flatnonzero(leaf["value"] == goal[leaf["doc"]])
                top = top[np.unique(leaf["doc"][top], return_index=True)[1]]
                place = leaf["at"][top]
                old = leaf["edge_at"][place]
                node = lat.source[old].astype(np.int64)
                out = [leaf["out"].setdefault(t, [e]) for t, e in zip(top.tolist(), old.tolist())]
                new, rest = lat.draw_other(node, uniform(self.keys[of], place, 16 * turn + 4), out)
                for x, e in zip(out, new.tolist()):
                    x.append(e)
                leaf["value"][top] = truncated(leaf["before"][top] + rest, uniform(self.keys[of], place, 16 * turn + 5), best[of])
                for lo, hi in zip(self.offsets[of].tolist(), place.tolist()):
                    path[lo:hi] = leaf["edge_at"][lo:hi]
                path[place] = new
                since[of] = place + 1
                on = lat.target[new] > 0
                starts.append((place + lat.size[new])[on])
                nodes.append(lat.target[new[on]])
            fresh = self.word > since[self.doc[self.word]] - 1
            at = np.concatenate([*starts, self.word[fresh]])
            node = np.concatenate([*nodes, self.root[fresh]])
            self._walk(path, at, node, 16 * turn + 6)
            leaf = self._regions(path, since, best, 16 * turn + 7)
            leaves.append(leaf)
            for d in live.tolist():
                a, b = leaf["cut"][d : d + 2]
                found[d].append((path[leaf["at"][a:b]], float(leaf["total"][d]), float(best[d])))
        return found

    def ids(self, paths: list[np.ndarray], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of a path each of texts ``docs``, all in a row, and the number of each."""
        lat, edges = self.lattice, np.concatenate([np.zeros(0, np.int32), *paths])
        many = np.array([len(p) for p in paths], np.int64)
        last = np.cumsum(many)
        if not len(edges):
            return np.zeros(0, np.int32), many
        ids = lat.id[edges]
        if (ids >= 0).all():
            return ids, many
        size = lat.size[edges].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(size)])
        bare = np.flatnonzero(ids < 0)
        if (size[bare] == 1).all():
            row = np.searchsorted(last, bare, "right")
            ids[bare] = self.v.byte_id[self.data[upto[bare] + (self.offsets[docs] - upto[last - many])[row]]]
            return ids, many
        start = upto[:-1] + np.repeat(self.offsets[docs] - upto[last - many], many)
        n = np.where(ids < 0, size, 1)
        stop = np.cumsum(n)
        out = np.repeat(ids, n)
        bare = np.flatnonzero(out < 0)
        where = np.repeat(start - (stop - n), n)[bare] + bare
        out[bare] = self.v.byte_id[self.data[where]]
        total = np.concatenate([[0], stop])
        return out, total[last] - total[last - many]

    def spelled(self, ids: np.ndarray, many: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Whether the ids (``many`` of each) spell the bytes of texts ``docs``."""
        spelt = self.v.spelling.take(pa.array(ids, mask=ids < 0))
        upto, last = np.frombuffer(spelt.buffers()[1], np.int32)[: len(ids) + 1], np.cumsum(many)
        length, want = upto[last] - upto[last - many], np.diff(self.offsets)[docs]
        out = length == want
        if not out.all():  # the others are compared by themselves
            keep = np.repeat(out, many)
            out[out] = self.spelled(ids[keep], many[out], docs[out])
            return out
        if not upto[-1]:
            return out
        got, stop = np.frombuffer(spelt.buffers()[2], np.uint8)[: upto[-1]], np.cumsum(want)
        own = self.data if len(self.data) == stop[-1] and (np.diff(docs) > 0).all() else self.data[np.repeat(self.offsets[docs] - (stop - want), want) + np.arange(stop[-1])]
        out[np.searchsorted(stop, np.flatnonzero(got != own), "right")] = False
        return out


_KEPT: dict[tuple[str, float], Vocabulary] = {}
_LATTICES: dict[Vocabulary, Lattices] = {}


def vocabulary(path: str, temperature: float = TEMPERATURE) -> Vocabulary:
    """The vocabulary of a model file, one per process."""
    if (path, temperature) not in _KEPT:
        _KEPT[path, temperature] = Vocabulary(path, temperature)
    return _KEPT[path, temperature]


def lattices(v: Vocabulary) -> Lattices:
    """The lattices kept for a vocabulary, one store per process."""
    if v not in _LATTICES:
        _LATTICES[v] = Lattices(v)
    return _LATTICES[v]


def log_inclusion(log_prob: np.ndarray, kappa: np.ndarray) -> np.ndarray:
    x = np.asarray(log_prob - kappa, np.float64)
    return np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.clip(x, -30, 700.0)))))


def sampled(docs: DataFrame, model: str, k: int = SAMPLES, temperature: float = TEMPERATURE, with_ids: bool = True, seed: int = 1) -> DataFrame:
    """Up to ``k`` distinct segmentations of each row's text, best perturbed value first.

    Columns: doc_id, sample (from 1), n_tokens, ids_crc32 (ids as
    little-endian unsigned 32-bit integers), log_prob, perturbed,
    log_inclusion, decoded (whether the ids give back the text byte for byte),
    and with ``with_ids`` ids. Null and empty texts have one segmentation, of no
    pieces; a text with fewer than ``k`` segmentations has all of them, each
    with an inclusion of 1. The row key is the doc_id (a null one has a key of
    its own), so repeated rows have the same samples. U+2581 in a text goes as
    bytes. Texts are read whole; other columns are not read; an empty table
    gives an empty result.
    """
    if k < 1:
        raise ValueError("k must be positive")
    ship(docs.sparkSession)
    names = ["doc_id", "sample", "n_tokens", "ids_crc32", "log_prob", "perturbed", "log_inclusion", "decoded", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        v = vocabulary(model, temperature)
        for b in batches:
            row_ids = b.column(0).to_pylist()
            keys = mix64(np.array([0x5BD1E995 if i is None else i & (1 << 64) - 1 for i in row_ids], np.uint64) + np.uint64(seed) * _GOLD)
            for lo, hi, data, offsets in texts(b.column(1), SLICE_BYTES):
                s = Sampler(v, data, offsets, keys[lo:hi])
                found = s.run(k)
                for rank in range(k):
                    of = np.array([d for d, paths in enumerate(found) if len(paths) > rank], np.int64)
                    if not len(of):
                        break
                    ids, many = s.ids([found[d][rank][0] for d in of], of)
                    ids = ids.astype("<i4")
                    cut = np.concatenate([[0], np.cumsum(many)])
                    log_prob, value = (np.array([found[d][rank][i] for d in of]) for i in (1, 2))
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]
                    columns = [b.column(0)[lo:hi].take(pa.array(of)), pa.array(np.full(len(of), rank + 1, np.int32)), pa.array(many), pa.array(crc, pa.int64()), pa.array(log_prob), pa.array(value), pa.array(log_inclusion(log_prob, s.kappa[of])), pa.array(s.spelled(ids, many, of))]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids)))
                    yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, sample int, n_tokens long, ids_crc32 long, log_prob double, perturbed double, log_inclusion double, decoded boolean" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(mapped(run, schema))


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and the model's own best ids for each text; null counts as empty."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in batches:
            ids = [v.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(mapped(run, "doc_id long, ids array<int>"))


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows of ids; null ids give a null text, bytes that are no UTF-8 the replacement character."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for b in batches:
            out = [None if i is None else v.decode(np.array(i, np.int64)).decode(errors="replace") for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").transform(mapped(run, "doc_id long, text string"))
