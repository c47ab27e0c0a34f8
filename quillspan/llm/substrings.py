"""Substring dedup by seed and extend, without pairs.

Every run of ``LENGTH`` words that also starts earlier (smaller doc_id, or
the same document further left) is a repeat; its words go.

Seeds. Winnowing picks, in each window of ``LENGTH`` words, the least hash
among its ``SEED``-word grams (the leftmost at ties) as the window's anchor. It
depends on the window alone, so equal windows have equal anchors.

Extension. Neighbouring windows with the same anchor form a stretch: the
anchor extended both ways as far as it is the anchor. Documents are joined on
anchor and stretch hash (128 bits together, of two independent hashes of the
words): all but the first occurrence of a
stretch repeat over their whole length. Where an anchor stands in different
stretches, at the ends of a repeat, the first occurrence of each stretch is
extended window by window and compared the same way. The union of repeated
windows is the set of maximal repeats.

Hot passages. Each batch of documents first keeps only its own first
occurrence of a stretch or window and settles the others on the spot, so a
passage found in a third of all documents reaches the join once a batch, not
once a document. An anchor that a batch already sees in several stretches is
dealt by stretch, with one witness row for the anchor's own partition.

Documents without any repeat never enter a shuffle: a key filter of fixed size
(1 MiB) sends only those that may have one to the joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.runtime import key_filter, mapped, maybe_in, mix64, ship, written
from quillspan.llm.words import Words, segment_hashes, split_words, texts

LENGTH, SEED = 20, 8
_STRETCH, _FIRST, _SECOND, _GRAM = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3
#: Flags in the packed place of a row: start << 8 | flags | number of windows.
_MARKED, _SETTLED, _WITNESS = 32, 64, 128
_ROW = ["a", "c", "d", "p"]
_LOWEST = -(1 << 63)


def stretches(w: Words, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each stretch: anchor hash, stretch hash, first word, number of windows."""
    n = len(w.hash)
    left = np.repeat(w.first[1:], w.count) - np.arange(n)
    starts = np.flatnonzero(left >= length)
    if not len(starts):
        e = np.zeros(0, np.uint64)
        return e, e, np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = n - seed + 1
    at = np.arange(grams)
    g = segment_hashes(w.hash, at, at + seed, _GRAM)
    span = length - seed + 1
    least, width = g, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    least = least[starts]
    anchor = np.zeros(len(starts), np.int64)
    for j in range(span - 1, -1, -1):
        here = starts + j
        hit = g[here] == least
        anchor[hit] = here[hit]
    new = np.ones(len(starts), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    lead = np.flatnonzero(new)
    lo, many = starts[lead], np.diff(np.append(lead, len(starts)))
    return g[anchor[lead]], segment_hashes(w.second, lo, lo + many + length - 1, _STRETCH), lo, many


def _firsts(one: np.ndarray, two: np.ndarray, d: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the first occurrence (d, then p) of each (one, two), and of the later ones; rows at the place of the first are neither."""
    key = mix64(one + two * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    k = key[order]
    alone = np.ones(len(k), bool)
    alone[1:] &= k[1:] != k[:-1]
    alone[:-1] &= k[:-1] != k[1:]
    first, again = order[alone], order[~alone]
    again = again[np.lexsort((p[again], d[again], two[again], one[again]))]
    new = _new(one[again], two[again])
    return np.concatenate([first, again[new]]), again[~new & ~_same_place(new, d[again], p[again])]


def _new(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether rows in order begin another (one, two)."""
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return new


def _same_place(new: np.ndarray, d: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether rows stand at the document and place of the first row of their group: rows that share a doc_id don't outrank one another."""
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    return (d == d[head]) & (p >> 8 == p[head] >> 8)


def _rows(*columns: np.ndarray, names: list[str] = _ROW) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64)) for c in columns], names)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_LOWEST).to_numpy(zero_copy_only=False).astype(np.int64)


def _seed(length: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, got = _ids(b.column(0)), []
            for lo, hi, data, offsets in texts(b.column(1)):
                w = split_words(data, offsets)
                a, c, start, many = stretches(w, length, seed)
                doc = np.searchsorted(w.first, start, "right") - 1
                got.append((a, c, ids[lo:hi][doc], (start - w.first[doc]) << 8 | many))
            if not got:
                continue
            a, c, d, p = (np.concatenate(x) for x in zip(*got))
            if not len(a):
                continue
            first, again = _firsts(a, c, d, p)
            if len(again):
                yield _rows(mix64(d[again].view(np.uint64) + p[again].view(np.uint64)), np.zeros(len(again), np.uint64), d[again], p[again] | _SETTLED)
            a, c, d, p = a[first], c[first], d[first], p[first]
            order = np.argsort(a, kind="stable")
            same = np.zeros(len(a) + 1, bool)
            same[1:-1] = a[order][1:] == a[order][:-1]
            many = np.zeros(len(a), bool)
            many[order] = same[:-1] | same[1:]
            yield _rows(a, c, d, np.where(many, p | _MARKED, p))
            seen = np.unique(a[many])
            if len(seen):
                zero = np.zeros(len(seen), np.int64)
                yield _rows(seen, zero, zero, zero + _WITNESS)

    return run


def _join_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (a, c, d, p) -> repeats (kind 0) and first occurrences to extend by window (kind 1)."""

    def settle(a, c, d, p):
        done = (p & _SETTLED) > 0
        witness, marked = (p & _WITNESS) > 0, (p & _MARKED) > 0
        real = ~done & ~witness
        group = np.cumsum(np.append(True, a[1:] != a[:-1])) - 1
        kind = np.full(len(a), -1, np.int64)
        kind[done] = 0
        at = np.flatnonzero(real)
        new = _new(a[at], c[at])
        kind[at[~new & ~_same_place(new, d[at], p[at])]] = 0
        heads = np.bincount(group[at[new]], minlength=group[-1] + 1)
        wide = (heads > 1) | (np.bincount(group, witness | marked, minlength=group[-1] + 1) > 0)
        kind[at[new]] = np.where(wide[group[at[new]]], 1, -1)
        k = kind >= 0
        return _rows(d[k], p[k] >> 8, p[k] & 31, kind[k], names=["d", "s", "n", "kind"])

    held: list[list[np.ndarray]] = []  # parts of one anchor's rows, put together once
    together = lambda parts: [np.concatenate(x) for x in zip(*parts)]
    for b in batches:
        cols = [x.to_numpy(zero_copy_only=False) for x in b.columns]
        if held and cols[0][0] != held[0][0][0]:
            yield settle(*together(held))
            held = []
        change = np.flatnonzero(cols[0][1:] != cols[0][:-1])
        if len(change):
            cut = change[-1] + 1
            yield settle(*together([*held, [x[:cut] for x in cols]]))
            held, cols = [], [x[cut:] for x in cols]
        held.append(cols)
    if held:
        yield settle(*together(held))


def _extend(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, got = _ids(b.column(0)), []
            for lo, hi, data, offsets in texts(b.column(1)):
                w = split_words(data, offsets)
                spans = b.column(2)[lo:hi]
                n = np.diff(spans.offsets.to_numpy())
                packed = spans.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(hi - lo), n)
                many = packed & 31
                last = np.cumsum(many)
                off = np.arange(many.sum()) - np.repeat(last - many, many)
                doc, start = np.repeat(doc, many), np.repeat(packed >> 8, many) + off
                fits = start + length <= w.count[doc]
                doc, start = doc[fits], start[fits]
                at = w.first[doc] + start
                got.append((segment_hashes(w.hash, at, at + length, _FIRST), segment_hashes(w.second, at, at + length, _SECOND), ids[lo:hi][doc], start << 8 | 1))
            if not got:
                continue
            a, c, d, p = (np.concatenate(x) for x in zip(*got))
            if not len(a):
                continue
            first, again = _firsts(a, c, d, p)
            yield _rows(a[first], c[first], d[first], p[first])
            if len(again):
                yield _rows(mix64(d[again].view(np.uint64) + p[again].view(np.uint64)), np.zeros(len(again), np.uint64), d[again], p[again] | _SETTLED)

    return run


def _join_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (a, c, d, p) -> all but the first of each (a, c)."""
    last = None  # the first row of the group at hand
    for b in batches:
        a, c, d, p = (x.to_numpy(zero_copy_only=False) for x in b.columns)
        repeat = (p & _SETTLED) > 0
        at = np.flatnonzero(~repeat)
        if len(at):
            own = [x[at] for x in (a, c, d, p)]
            if last is not None:
                own = [np.append(x, y) for x, y in zip(last, own)]
            new = _new(own[0], own[1])
            later = ~new & ~_same_place(new, own[2], own[3])
            head = np.flatnonzero(new)[-1]
            repeat[at] = later[-len(at) :]
            last = [x[head : head + 1] for x in own]
        yield _rows(d[repeat], p[repeat] >> 8, p[repeat] & 31, names=["d", "s", "n"])


def _by_document(rows: DataFrame) -> DataFrame:
    return rows.groupBy("d").agg(F.collect_list(F.col("s") * 256 + F.col("n")).alias("_spans"))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _key() -> F.Column:
    return F.coalesce("doc_id", F.lit(_LOWEST))


def repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Repeated windows as runs: d (doc_id), s (first word), n (number of windows). Written to the shared folder."""
    if not 1 <= seed <= length or length - seed + 1 > 31:
        raise ValueError("1 <= seed <= length <= seed + 30")
    ship(docs.sparkSession)
    rows = _texts(docs)
    seeds = rows.transform(mapped(_seed(length, seed), "a long, c long, d long, p long"))
    marked = F.col("p").bitwiseAND(_MARKED) > 0
    dealt = seeds.repartition(F.when(marked, F.xxhash64("a", "c")).otherwise(F.xxhash64("a"))).sortWithinPartitions(*_ROW)
    found = written(dealt.transform(mapped(_join_stretches, "d long, s long, n long, kind long")), "stretches", wide=True)
    edges = _by_document(found.where("kind = 1"))
    maybe = maybe_in(docs.sparkSession, key_filter(found.where("kind = 1").select("d")))
    open_ends = rows.where(maybe(_key())).join(edges, _key() == F.col("d")).select("doc_id", "text", "_spans")
    windows = open_ends.transform(mapped(_extend(length), "a long, c long, d long, p long"))
    again = windows.repartition(F.col("a")).sortWithinPartitions(*_ROW).transform(mapped(_join_windows, "d long, s long, n long"))
    return written(found.where("kind = 0").select("d", "s", "n").unionByName(again), "repeats", wide=True)


def _kept(length: int, with_text: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept_text", "repeats"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in texts(b.column(1)):
                w = split_words(data, offsets)
                gone = np.zeros(len(w.hash) + 1, np.int64)
                if b.num_columns > 2 and b.column(2).null_count < len(b):
                    spans = b.column(2)[lo:hi]
                    n = np.array([len(x) if x is not None else 0 for x in spans.to_pylist()]) if spans.null_count else np.diff(spans.offsets.to_numpy())
                    packed = spans.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    doc = np.repeat(np.arange(hi - lo), n)
                    start = np.minimum(packed >> 8, w.count[doc])
                    stop = np.minimum(start + (packed & 255) + length - 1, w.count[doc])
                    np.add.at(gone, w.first[doc] + start, 1)
                    np.add.at(gone, w.first[doc] + stop, -1)
                removed = np.cumsum(gone[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(removed)])
                stay = np.flatnonzero(~removed)
                size = w.end[stay] - w.start[stay] + 1
                last = np.cumsum(size)
                flat = np.arange(last[-1] if len(last) else 0)
                flat = data[np.minimum(np.repeat(w.start[stay] - (last - size), size) + flat, max(len(data) - 1, 0))] if len(flat) else np.zeros(0, np.uint8)
                flat[last - 1] = 32
                ends = np.concatenate([[0], last])[np.searchsorted(stay, w.first)]
                raw = flat.tobytes()
                kept = [raw[s : max(s, e - 1)] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]
                cols = [b.column(0)[lo:hi], pa.array(w.count, pa.int64()), pa.array(total[w.first[1:]] - total[w.first[:-1]], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
                if with_text:
                    found = []
                    for f, t in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
                        own = np.diff(np.concatenate([[0], removed[f:t].astype(np.int8), [0]]))
                        found.append([{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(own == 1), np.flatnonzero(own == -1))])
                    cols += [pa.array([k.decode() for k in kept], pa.string()), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def deduplicated(docs: DataFrame, length: int = LENGTH, seed: int = SEED, with_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256, and with ``with_text`` kept_text and the maximal repeats (word positions).

    Null and empty texts have no words; a text of fewer than ``length`` words
    keeps all. Rows that repeat a doc_id stand at the same place: they don't
    outrank one another, and what one loses all lose. A null doc_id counts as
    the smallest. Texts of any length are read whole; other columns are not
    read; an empty table gives an empty result.
    """
    found = repeats(docs, length, seed)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string, repeats array<struct<start:long,end:long>>" if with_text else "")
    maybe = maybe_in(docs.sparkSession, key_filter(found.select("d")))
    rows, run = _texts(docs), _kept(length, with_text)
    clean = rows.where(~maybe(_key())).transform(mapped(run, schema))
    touched = rows.where(maybe(_key())).join(_by_document(found), _key() == F.col("d"), "left").select("doc_id", "text", "_spans")
    return clean.unionByName(touched.transform(mapped(run, schema)))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM w WHERE len(ws) >= 20)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + unnest(range(20)) AS p FROM dup),
one AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM w WHERE len(ws) > 0),
kept AS (SELECT o.doc_id, count(*) FILTER (WHERE g.p IS NOT NULL) AS n_removed, coalesce(string_agg(o.word, ' ' ORDER BY o.p) FILTER (WHERE g.p IS NULL), '') AS t
  FROM one o LEFT JOIN gone g ON g.doc_id = o.doc_id AND g.p = o.p GROUP BY o.doc_id)
SELECT w.doc_id, len(w.ws) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""
