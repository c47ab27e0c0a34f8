"""Exact byte-level BPE of whole texts at the speed of distinct words.

The pre-tokenizer of the vocabulary always cuts between a letter and a mark, or
before a single space between visible characters, so a text falls into pieces
there. Equal pieces have equal ids wherever they stand: each distinct piece
goes through the tokenizers library once, and ids are gathered from a bounded
cache. The vocabulary's special tokens are found in texts as the library finds
them: each occurrence is a piece, and what stands beside it is cut there.
"""

from __future__ import annotations

import json
import re

import numpy as np
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

from quillspan.llm.words import byte_hashes

#: Pieces kept per process; beyond it the cache starts anew.
CACHE_CHUNKS = 500_000


#: Byte classes: 1 letter, 2 digit, 3 other visible ASCII, 4 apostrophe, 5 a line break or tab, 0 anything else.
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[39] = 4
_CLASS[9:14] = 5
#: _CUT[a, b]: a piece always ends between neighbours of these classes. An apostrophe may start a contraction, so none ends behind it before a letter.
_CUT = np.zeros((6, 6), bool)
for _a in (1, 2, 3, 4):
    for _b in (1, 2, 3, 4):
        _CUT[_a, _b] = _a != _b and {_a, _b} != {3, 4} and (_a, _b) != (4, 1)


def _classes(data: np.ndarray) -> np.ndarray:
    """Class of each byte; letters of U+00C0..U+00FF count as letters, both bytes."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = 1
    return kind


def _edges(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, spots: list[tuple[int, int]]) -> np.ndarray:
    """Starts of pieces: text starts, changes of class, a single space or line break between visible characters; both ends of special tokens (``spots``)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[1:n] = _CUT[kind[:-1], kind[1:]]
    seen = (kind > 0) & (kind < 5)
    at = np.flatnonzero((data == 32) | (kind == 5))
    at = at[(at > 0) & (at < n - 1)]
    at = at[seen[at - 1] & seen[at + 1]]
    edge[at] = True
    edge[at[kind[at] == 5] + 1] = True
    for s, e in spots:
        edge[s + 1 : e] = False
        edge[s] = edge[e] = True
    edge[offsets] = True
    edge[n] = False
    return np.flatnonzero(edge)


class ChunkEncoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
            raise ValueError("special tokens that depend on what stands beside them aren't supported")
        names = sorted((t.content.encode() for t in added), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, names))) if names else None
        one = [np.frombuffer(x, np.uint8) for x in names]
        self.special_hashes = np.array([byte_hashes(x, np.array([0]), np.array([len(x)]))[0] for x in one], np.uint64)
        vocab = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.bytes_of[i] = len(token)
        # the same model without pre-tokenizer, for pieces spelled in the vocabulary's byte alphabet
        spec = json.loads(self.tokenizer.to_str())
        spec |= {"pre_tokenizer": None, "post_processor": None, "decoder": None, "added_tokens": []}
        self.pieces = Tokenizer.from_str(json.dumps(spec))
        self.pieces.pre_tokenizer = CharDelimiterSplit("\n")
        hidden = np.ones(256, bool)
        hidden[33:127] = hidden[161:173] = hidden[174:256] = False
        self.codes = np.arange(256, dtype="<u4")
        self.codes[hidden] = 256 + np.arange(hidden.sum())
        self._reset()

    def _reset(self) -> None:
        self.hash, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, data: np.ndarray, kind: np.ndarray, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Pieces of one class with at most a leading space are single pieces to the pre-tokenizer too; they go in at once, the rest one by one."""
        body = start + (data[start] == 32)
        known = np.minimum(body, end - 1)
        size = end - known
        last = np.cumsum(size)
        flat = kind[np.repeat(known - (last - size), size) + np.arange(last[-1])]
        least, most = np.minimum.reduceat(flat, last - size), np.maximum.reduceat(flat, last - size)
        whole = ~np.isin(hashes, self.special_hashes) & (body < end) & (least > 0) & (most < 5) & ((least == most) | (least == 3) & (most == 4))
        order = np.argsort(~whole, kind="stable")
        hashes, start, end, cut = hashes[order], start[order], end[order], int(whole.sum())
        ids, counts = [], []
        if cut:
            size = end[:cut] - start[:cut] + 1
            last = np.cumsum(size)
            take = np.repeat(start[:cut] - (last - size), size) + np.arange(last[-1])
            code = self.codes[data[np.minimum(take, len(data) - 1)]]
            code[last - 1] = 10
            got = np.array(self.pieces.encode_batch_fast([code.tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, np.uint32)
            ends, want = np.cumsum(self.bytes_of[got]), last - np.arange(1, cut + 1)
            upto = np.searchsorted(ends, want)
            if ends[-1] != want[-1] or (ends[upto] != want).any():
                raise ValueError("the vocabulary lacks some bytes")
            ids.append(got)
            counts.append(np.diff(upto + 1, prepend=0))
        if cut < len(start):
            raw = data.tobytes()
            for e in self.tokenizer.encode_batch_fast([raw[s:t].decode() for s, t in zip(start[cut:].tolist(), end[cut:].tolist())], add_special_tokens=False):
                ids.append(np.array(e.ids, np.uint32))
                counts.append(np.array([len(e.ids)]))
        new_n = np.concatenate(counts)
        new_at = len(self.ids) + np.cumsum(new_n) - new_n
        self.ids = np.concatenate([self.ids, *ids])
        order = np.argsort(hashes)
        to = np.searchsorted(self.hash, hashes[order])
        self.hash, self.at, self.n = (np.insert(old, to, new[order]) for old, new in ((self.hash, hashes), (self.at, new_at), (self.n, new_n)))

    def _spots(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
        """Special tokens within one text each, from left to right."""
        out: list[tuple[int, int]] = []
        if self.special is None:
            return out
        raw, at = data.tobytes(), 0
        while found := self.special.search(raw, at):
            s, e = found.span()
            whole = e <= offsets[np.searchsorted(offsets, s, "right")]
            if whole:
                out.append((s, e))
            at = e if whole else s + 1
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of ids of each."""
        kind = _classes(data)
        start = _edges(data, offsets, kind, self._spots(data, offsets))
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        end = np.append(start[1:], len(data))
        hashes, first, which = np.unique(byte_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.hash) > CACHE_CHUNKS:
            self._reset()
        at = np.searchsorted(self.hash, hashes)
        new = (at == len(self.hash)) | (self.hash[np.minimum(at, len(self.hash) - 1)] != hashes) if len(self.hash) else np.ones(len(hashes), bool)
        if new.any():
            self._learn(data, kind, hashes[new], start[first[new]], end[first[new]])
            at = np.searchsorted(self.hash, hashes)
        n = self.n[at][which]
        last = np.cumsum(n)
        ids = self.ids[np.repeat(self.at[at][which] - (last - n), n) + np.arange(last[-1])]
        total = np.concatenate([[0], last])
        return ids, np.diff(total[np.searchsorted(start, offsets)])


_KEPT: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The encoder of a vocabulary file, one per process."""
    if path not in _KEPT:
        _KEPT[path] = ChunkEncoder(path)
    return _KEPT[path]
