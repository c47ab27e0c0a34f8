"""Words and word n-grams of whole batches of texts as numpy arrays.

A word is a maximal run of characters other than space and U+0009..U+000D.
Those bytes never occur inside a multi-byte UTF-8 character, so everything
works on bytes. A word's hash mixes its eight-byte pieces, each with its place,
before they are summed; a run of words is hashed by doubling: the hash of 2k
words mixes those of its halves. Nothing is linear in the bytes or words, so no
family of strings collides by construction. Hashes depend on content only and
are alike on every executor. ``second`` is an independent hash of the same
words, for 128 bits together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from quillspan.llm.runtime import mix64

_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_R, _Q = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept per process."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[base] = (out[0], out[1])
    return have[0][:n], have[1][:n]


@dataclass
class Words:
    """Words of consecutive texts: byte ranges in ``data``, a hash each, and ``first[i]:first[i+1]`` for text i."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def second(self) -> np.ndarray:
        """Another hash of each word, of ``data`` as it is (lower case if the words are)."""
        return byte_hashes(self.data, self.start, self.end, 0x6A09E667F3BCC909)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)


_MASK = np.array([0, *((1 << 8 * n) - 1 for n in range(1, 9))], np.uint64)


def byte_hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of the bytes ``data[lo:hi]`` for each pair (``lo < hi``)."""
    if not len(lo):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.ndarray(len(data) + 1, "<u8", buffer=padded, strides=(1,))
    size = hi - lo
    out = word[lo] & _MASK[np.minimum(size, 8)]
    long = np.flatnonzero(size > 8)
    if len(long):
        many = (size[long] + 7) // 8
        last = np.cumsum(many)
        place = np.arange(last[-1]) - np.repeat(last - many, many)
        at = np.minimum(np.repeat(lo[long], many) + 8 * place, np.repeat(hi[long] - 8, many))
        out[long] = np.add.reduceat(mix64(word[at] ^ mix64(place.astype(np.uint64) * np.uint64(_Q) + np.uint64(salt ^ _R))), last - many)
    return mix64((out ^ np.uint64(salt)) + size.astype(np.uint64) * np.uint64(_Q))


def segment_hashes(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, salt: int) -> np.ndarray:
    """Hash of the run ``values[lo:hi]`` for each pair (``lo < hi``), from tables of runs of 1, 2, 4, ... values: a run is its first and its last such part, and its length."""
    out = np.zeros(len(lo), np.uint64)
    if not len(lo):
        return out
    size = hi - lo
    level = np.frexp(size.astype(np.float64))[1] - 1
    most, width, table = int(level.max()), 1, values + np.uint64(salt)
    some = np.bincount(level, minlength=most + 1)
    for k in range(most + 1):
        if some[k]:
            own = slice(None) if some[k] == len(lo) else np.flatnonzero(level == k)
            s, e, n = lo[own], hi[own], size[own]
            tail = table[s] if width == 1 or (n == width).all() else table[e - width]
            out[own] = mix64(table[s] * np.uint64(_R) ^ (tail + n.astype(np.uint64) * np.uint64(_Q)))
        if k < most:
            table = mix64(table[:-width] * np.uint64(_R) ^ (table[width:] + np.uint64(_Q)))
            width *= 2
    return out


def split_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, between: np.ndarray = _SPACE) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i+1]]``, of their ASCII lower case if ``lower``. ``between``: for each byte, whether it stands between words."""
    if lower:
        data = _LOWER[data]
    n = len(data)
    word = ~between[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    start = np.flatnonzero(word & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    return Words(data, offsets, start, end, byte_hashes(data, start, end), np.searchsorted(start, offsets))


def texts(array: pa.Array, most_bytes: int = 1_000_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices (from row, to row, bytes, offsets) of a string array, nulls as empty; a slice holds at most ``most_bytes`` or one text."""
    array = array.cast(pa.large_string()).fill_null("") if len(array) else array.cast(pa.large_string())
    if not len(array):
        return
    _, where, data = array.buffers()
    offs = np.frombuffer(where, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(array):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most_bytes, "right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``size``-word shingle and the index of its text; a text of fewer words has its whole sequence as one."""
    counts = w.count
    per = np.where(counts == 0, 0, np.maximum(1, counts - size + 1))
    text = np.repeat(np.arange(len(counts)), per)
    lo = np.repeat(w.first[:-1], per) + np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    hi = np.minimum(lo + size, np.repeat(w.first[1:], per))
    return segment_hashes(w.hash, lo, hi, _Q), text


def distinct_shingles(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingles``, each once per text, ordered by text and hash."""
    h, text = shingles(w, size)
    cut = np.searchsorted(text, np.arange(len(w.first)))
    for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
        h[s:e].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[keep], text[keep]


_WORDS = re.compile(rb"[^\x20\x09-\x0d]+")


def word_shingles(text: bytes, size: int) -> set[bytes]:
    """The distinct shingles themselves, ASCII lower case: what hashes are confirmed by."""
    w = _WORDS.findall(text.lower())
    return {b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
