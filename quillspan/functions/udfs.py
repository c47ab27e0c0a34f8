"""What no built-in expresses, as Arrow functions: repetition, compatibility forms, token counts, language detectors."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillspan.functions import text as T
from quillspan.session import ship

SPAN, REPEATS = 60, 5
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def _span_hashes(points: np.ndarray, span: int) -> np.ndarray:
    """A hash of ``points[i : i + span]`` for each i, by doubling: two halves make a whole, the last step overlaps."""
    table, width = _mixed(points.astype(np.uint64) + _ODD), 1
    while width * 2 <= span:
        table = _mixed(table[:-width] * _ODD ^ table[width:])
        width *= 2
    rest = span - width
    return _mixed(table[: len(table) - rest] * _ODD ^ table[rest:]) if rest else table


def loops(texts: list[str], span: int = SPAN, repeats: int = REPEATS) -> np.ndarray:
    """For each text whether some stretch of ``span`` characters stands at ``repeats`` places that don't overlap.

    All stretches of all texts are hashed at once; those with enough places are
    followed from place to place together, the next one at or after the end of
    the last. What is found is confirmed on the text.
    """
    out = np.zeros(len(texts), bool)
    long = [i for i, t in enumerate(texts) if t is not None and len(t) >= span * repeats]
    if not long:
        return out
    size = np.array([len(texts[i]) for i in long])
    points = np.frombuffer("".join(texts[i] for i in long).encode("utf-32-le", "surrogatepass"), "<u4")
    last = np.cumsum(size)
    here = np.concatenate([np.arange(e - n, e - span + 1) for e, n in zip(last.tolist(), size.tolist())])
    of = np.repeat(np.arange(len(long)), size - span + 1)
    key = _mixed(_span_hashes(points, span)[here] + of.astype(np.uint64) * _ODD)
    order = np.argsort(key, kind="stable")
    key, here, of = key[order], here[order], of[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    stop = np.append(first[1:], len(key))
    much = (stop - first >= repeats) & (here[stop - 1] - here[first] >= span * (repeats - 1))
    first, stop = first[much], stop[much]
    group = np.repeat(np.arange(len(first)), stop - first)
    if not len(group):
        return out
    many = stop - first
    rows = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(len(group))
    place = group * (len(points) + span) + here[rows]  # ascending: by group, then by place
    places = [here[first]]
    for _ in range(repeats - 1):
        at = np.searchsorted(place, np.arange(len(first)) * (len(points) + span) + places[-1] + span)
        there = (at < len(group)) & (group[np.minimum(at, len(group) - 1)] == np.arange(len(first)))
        first, places = first[there], [p[there] for p in places]
        at = at[there]
        keep = np.isin(group, np.flatnonzero(there))
        renumber = np.cumsum(there) - 1
        group, rows = renumber[group[keep]], rows[keep]
        at = (np.cumsum(keep) - 1)[at]
        place = group * (len(points) + span) + here[rows]
        places.append(here[rows[at]])
    for k in range(len(first)):
        i = of[first[k]]
        if not out[long[i]]:
            spans = {points[p[k] : p[k] + span].tobytes() for p in places}
            out[long[i]] = len(spans) == 1 or _plainly(texts[long[i]], span, repeats)
    return out


def _plainly(text: str, span: int, repeats: int) -> bool:
    """The same without hashes, for a text in which two stretches share one."""
    free: dict[str, list[int]] = {}
    for i in range(len(text) - span + 1):
        free.setdefault(text[i : i + span], []).append(i)
    for places in free.values():
        n, at = 0, -span
        for p in places:
            if p >= at + span:
                n, at = n + 1, p
        if n >= repeats:
            return True
    return False


def _shipped() -> None:
    """The functions below call others of this module, so executors need the package."""
    ship(SparkSession.active())


def may_loop(text: Column, span: int = SPAN, repeats: int = REPEATS) -> Column:
    """False only for texts that ``loops`` denies, by expressions alone.

    Words are what stands between blanks. Where none is longer than half a
    span, every stretch of ``span`` characters has a blank among its first ones,
    and what follows that blank up to ``span - span // 2 - 1`` characters still
    lies in the stretch. Equal stretches agree in it, so a text that loops has
    such a piece at ``repeats`` places. Texts with longer words may loop.
    """
    longest = span // 2
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s)(?<=[\x20\n\t])(?=(.{{{span - longest - 1}}}))"), F.lit(1))
    sorted_ = F.sort_array(F.transform(pieces, lambda p: F.xxhash64(p)))
    again = F.get(F.transform(F.array(sorted_), lambda h: F.exists(F.zip_with(h, F.slice(h, repeats, F.greatest(F.size(h), F.lit(1))), lambda a, b: a == b), lambda same: F.coalesce(same, F.lit(False)))), F.lit(0))
    return F.when(F.length(text) < span * repeats, False).when(text.rlike(rf"[^\x20\n\t]{{{longest + 1}}}"), True).otherwise(again)


def looping(text: Column, span: int = SPAN, repeats: int = REPEATS) -> Column:
    """``loops`` as a column; only texts that ``may_loop`` reach Python."""
    _shipped()

    @pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            rows = s.tolist()
            parts, size = [[]], 0
            for t in rows:  # a few million characters at a time
                parts[-1].append(t)
                size += len(t or "")
                if size > 2_000_000:
                    parts.append([])
                    size = 0
            yield pd.Series(np.concatenate([loops(p, span, repeats) for p in parts if p] or [np.zeros(0, bool)]))

    return F.coalesce(run(F.when(may_loop(text, span, repeats), text)), F.lit(False))


def gram_hashes(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words of texts whose words stand between single spaces, and the number of the text of each."""
    raw = np.frombuffer(" ".join(texts).encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = np.append(np.flatnonzero(raw == 32), len(raw))
    begin = np.append(0, last[:-1] + 1)
    place = np.arange(len(raw) + 1) - np.repeat(begin, np.diff(np.append(begin, len(raw) + 1)))
    letters = _mixed((np.append(raw, 32).astype(np.uint64) << np.uint64(32)) + place.astype(np.uint64) * _ODD)
    letters[last] = 0
    words = _mixed(np.add.reduceat(letters, begin) + (last - begin).astype(np.uint64) * _ODD)
    count = np.array([t.count(" ") + 1 for t in texts])  # an empty text counts as an empty word
    many = np.maximum(count - n + 1, 0)
    of = np.repeat(np.arange(len(texts)), many)
    if not len(of):
        return np.zeros(0, np.uint64), of
    start = np.repeat(np.cumsum(count) - count - (np.cumsum(many) - many), many) + np.arange(len(of))
    return _span_hashes(words, n)[start], of


def grams(norm: Column, n: int) -> Column:
    """``gram_hashes`` of each text, as an array of longs."""
    _shipped()

    @pandas_udf("array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            h, of = gram_hashes(s.tolist(), n)
            yield pd.Series(np.split(h.view(np.int64), np.searchsorted(of, np.arange(1, len(s)))), dtype=object)

    return run(F.coalesce(norm, F.lit("")))


class Overlaps:
    """Texts by language with the hashes of their n-grams: what ``overlap_reason`` broadcasts. Eight bytes a word for the hash, four for the number of its text, and the texts themselves."""

    def __init__(self, texts: dict[str, set[str]], n: int):
        self.n, self.texts, self.hashes, self.of = n, {}, {}, {}
        for key, own in texts.items():
            rows = sorted(own)
            h, of = gram_hashes(rows, n)
            order = np.argsort(h, kind="stable")
            self.texts[key], self.hashes[key], self.of[key] = rows, h[order], of[order].astype(np.int32)

    def shared(self, key: str, text: str, hashes: np.ndarray, places: np.ndarray) -> bool:
        """Whether the n-gram at one of the ``places`` of ``text`` stands in a text of its hash; confirmed on the words."""
        have, words = self.hashes[key], text.split(" ")
        for h, i in zip(hashes.tolist(), places.tolist()):
            gram = " " + " ".join(words[i : i + self.n]) + " "
            lo, hi = np.searchsorted(have, np.uint64(h)), np.searchsorted(have, np.uint64(h), "right")
            if any(gram in f" {self.texts[key][k]} " for k in dict.fromkeys(self.of[key][lo:hi].tolist())):
                return True
        return False


def overlap_reason(lang: Column, norm: Column, texts: dict[str, set[str]], n: int) -> Column:
    """``exact`` for a text that is among ``texts`` of its language, ``ngram`` for another that shares an n-gram with one of them, else null. Found by hashes, confirmed on the texts, which are broadcast with them."""
    _shipped()
    shared = SparkSession.active().sparkContext.broadcast(Overlaps(texts, n))

    @pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        bench = shared.value
        whole = {key: set(own) for key, own in bench.texts.items()}
        for langs, norms in batches:
            rows, out = norms.tolist(), np.full(len(norms), None, object)
            for key in set(langs.tolist()) & whole.keys():
                at = np.flatnonzero((langs == key).to_numpy())
                h, of = gram_hashes([rows[i] for i in at], n)
                have = bench.hashes[key]
                hit = np.flatnonzero(have[np.minimum(np.searchsorted(have, h), len(have) - 1)] == h) if len(have) else np.zeros(0, np.int64)
                first = np.searchsorted(of, np.arange(len(at)))
                for k in np.unique(of[hit]).tolist():
                    own = hit[of[hit] == k]
                    if bench.shared(key, rows[at[k]], h[own], own - first[k]):
                        out[at[k]] = "ngram"
                for i in at:
                    if rows[i] in whole[key]:
                        out[i] = "exact"
            yield pd.Series(out, dtype=object)

    return run(F.coalesce(lang, F.lit("")), F.coalesce(norm, F.lit("")))


def nfkc(text: Column) -> Column:
    """Compatibility composition; texts in ASCII pass without Python."""

    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: t if unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t), na_action="ignore")

    other = text.rlike(r"[^\x00-\x7F]")
    return F.when(other, run(F.when(other, text))).otherwise(text)


def norm(text: Column) -> Column:
    """Compatibility composition, lower case, one space between runs of word characters: the form in which texts are compared with benchmarks."""
    return T.normalised(nfkc(text))


def token_count(text: Column, encode: Callable[[], Callable[[str], int]] | None = None) -> Column:
    """Tokens of a text, 0 for null. ``encode`` makes the counter on the executor (a local tokenizer, ``sources.server.tokenize``); without it a proxy counts runs of letters, digits and single marks."""
    if encode is None:
        return F.coalesce(F.regexp_count(text, F.lit(r"[\p{L}]+|[0-9]+|[^\s\p{L}0-9]")), F.lit(0)).cast("long")

    @pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = encode()
        for s in batches:
            yield s.map(lambda t: count(t) if t else 0).astype("int64")

    return run(F.coalesce(text, F.lit("")))


def detected(text: Column, detector: Callable[[], Callable[[str], str | None]] | None = None) -> Column:
    """Language of a text: ``none`` for a blank one, ``other`` where the detector, made once on each executor, can't tell. Without one the heuristic of ``text.detect_language``."""
    if detector is None:
        return T.detect_language(text)

    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        detect = detector()
        for s in batches:
            yield s.map(lambda t: detect(t) or "other")

    blank = T.is_blank(text)
    return F.when(blank, "none").otherwise(run(F.when(blank, "").otherwise(text)))
