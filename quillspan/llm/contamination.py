"""Benchmark decontamination by size-partitioned MinHash containment search.

Items and documents are sets of five-word shingles (ASCII lower case). An item
is found in a document if at least ``threshold`` of its shingles occur there; an
item of fewer words is its whole sequence, found where these words stand in a row.

MinHash of a whole long document says nothing about a short item, so domains
are partitioned by size: items fall into classes of at most ``Q`` shingles, Q a
power of two from 8, and for every class a document is a row of segments of ``2 * Q``
shingles that overlap by ``Q``. A passage of the class lies within one segment,
where a containment of 0.8 means a Jaccard similarity of at least
0.8 q / (q + 2 Q - 0.8 q) >= 0.19 (q > Q / 2). With 64 hash functions, each a band of
its own, a match is missed with a probability under 2e-6. Items of up to four
shingles, or of fewer than five words, are looked up by the shingles or runs of
words themselves, which misses none.
Candidates are verified on the words, against all shingles of the whole document.

A benchmark whose index takes at most ``MOST_BYTES`` is broadcast and documents
are searched where they are read. A larger one is joined: what leaves
a document is the minima that a key filter of fixed size doesn't rule out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.runtime import key_filter, mapped, mix64, passes, ship, unused, whole_rows, written
from quillspan.llm.words import Words, distinct_shingles, shingles, split_words, texts, word_shingles

SHINGLE_WORDS, THRESHOLD, HASHES = 5, 0.8, 64
#: Bytes of the index that is broadcast at most: tables of keys and items, flags, sets and texts.
MOST_BYTES = 64 << 20
_FACTORS = np.random.Generator(np.random.PCG64(515)).integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LEAST_CLASS, _TINY = 8, 4
_FOUND = "doc_id long, item_id long, n_item long, n_shared long, containment double"


def classes_of(sizes: np.ndarray) -> np.ndarray:
    """Class of each item by its number of shingles; 0 for those looked up by shingle."""
    q = np.maximum(_LEAST_CLASS, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    return np.where(sizes <= _TINY, 0, q)


def minima(h: np.ndarray, first: np.ndarray, classes: list[int]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(class, hash function, document, minimum) of every segment; ``h[first[d]:first[d + 1]]`` are the shingles of document d in order."""
    n = np.diff(first)
    blocks = -(-n // _LEAST_CLASS)
    of = np.repeat(np.arange(len(n)), blocks)
    lead = np.cumsum(blocks) - blocks
    starts = first[:-1][of] + (np.arange(len(of)) - lead[of]) * _LEAST_CLASS
    if not len(of):
        return
    for i, f in enumerate(_FACTORS):
        least, doc, width = np.minimum.reduceat(h * f, starts), of, _LEAST_CLASS
        for q in classes:
            while width < q:  # halve the blocks of each document
                edge = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1])
                rank = np.arange(len(doc)) - np.repeat(edge, np.diff(np.append(edge, len(doc))))
                pair = np.flatnonzero(rank % 2 == 0)
                least, doc, width = np.minimum.reduceat(least, pair), doc[pair], width * 2
            two = least.copy()
            same = doc[1:] == doc[:-1]
            two[:-1][same] = np.minimum(least[:-1][same], least[1:][same])
            yield q, i, doc, two


class Lookup:
    """Sorted keys of items, and a table of flags that rules most others out."""

    def __init__(self, keys: np.ndarray, items: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.items = keys[order], items[order]
        self.flags = np.zeros(1 << 16, bool)
        self.flags[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def pairs(self, doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        maybe = np.flatnonzero(self.flags[(keys & np.uint64(0xFFFF)).astype(np.int64)])
        lo, hi = np.searchsorted(self.keys, keys[maybe]), np.searchsorted(self.keys, keys[maybe], "right")
        k = hi - lo
        last = np.cumsum(k)
        return np.repeat(doc[maybe], k), self.items[np.repeat(lo - (last - k), k) + np.arange(k.sum())]


class ItemIndex:
    """Index of a broadcast benchmark: ids, texts and, by class and hash function, the items' minima; of items under five words, by their number, the hashes of the words in a row."""

    def __init__(self, item_ids: list[int], sets: list[np.ndarray], words: list[bytes], lengths: list[int]):
        self.item_ids, self.words, self.lengths = item_ids, words, lengths
        self.exact: dict[int, set[bytes]] = {}
        length = np.array(lengths, np.int64)
        size = np.where(length < SHINGLE_WORDS, -length, classes_of(np.array([len(s) for s in sets], np.int64)))
        self.tables: dict[int, list[Lookup]] = {}
        self.tiny: dict[int, Lookup] = {}
        for q in np.unique(size).tolist():
            of = np.flatnonzero(size == q)
            every, many = np.concatenate([sets[k] for k in of]), np.array([len(sets[k]) for k in of])
            if q > 0:
                start = np.cumsum(many) - many
                self.tables[q] = [Lookup(np.minimum.reduceat(every * f, start), of) for f in _FACTORS]
            else:
                self.tiny[-q or SHINGLE_WORDS] = Lookup(every, np.repeat(of, many))

    def search(self, words: Words, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Candidate (document, item) pairs."""
        found, many = [np.zeros(0, np.int64)], max(1, len(self.item_ids))
        for q, i, doc, two in minima(h, first, list(self.tables)):
            d, k = self.tables[q][i].pairs(doc, two)
            found.append(d * many + k)
        for n, table in self.tiny.items():
            runs, of = shingles(words, n)
            d, k = table.pairs(of, runs)
            found.append(d * many + k)
        pairs = np.unique(np.concatenate(found))
        return pairs // many, pairs % many

    def shingles_of(self, k: int) -> set[bytes]:
        if k not in self.exact:
            self.exact[k] = word_shingles(self.words[k], SHINGLE_WORDS)
        return self.exact[k]


def _shingles(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Words, np.ndarray, np.ndarray]]:
    """Slices of texts with their bytes, their words, and their shingles in order with the first one of each text."""
    for lo, hi, data, offsets in texts(column):
        words = split_words(data, offsets, lower=True)
        h, of = shingles(words, SHINGLE_WORDS)
        yield lo, hi, data, offsets, words, h, np.searchsorted(of, np.arange(hi - lo + 1))


def item_sets(items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """Distinct shingles of each item as little-endian bytes, with their number, the number of words and the text; items without words or without an id are left out."""
    ship(items.sparkSession)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in texts(b.column(1)):
                words = split_words(data, offsets, lower=True)
                h, of = distinct_shingles(words, SHINGLE_WORDS)
                cut = np.searchsorted(of, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(np.diff(cut), pa.int64()), pa.array(words.count, pa.int64()), pa.array([h[s:e].tobytes() for s, e in zip(cut, cut[1:])], pa.binary()), b.column(1)[lo:hi]], ["item_id", "n", "words", "set", "text"])

    rows = items.select(F.col(item_id).cast("long").alias("item_id"), "text").where(F.col(item_id).isNotNull())
    return rows.transform(mapped(sets, "item_id long, n long, words long, set binary, text string")).where("n > 0")


def _index(sets: DataFrame) -> ItemIndex | None:
    """The index of a benchmark that is small enough to broadcast."""
    items, n, size, largest = sets.agg(F.count("*"), F.sum("n"), F.sum(F.octet_length("text")), F.max("n")).first()
    classes = max(1, int(largest or 0).bit_length())
    if items * HASHES * 16 + classes * HASHES * (1 << 16) + 8 * (n or 0) + (size or 0) > MOST_BYTES:
        return None
    got = sets.select("item_id", "set", "words", "text").toArrow()
    order = sorted(range(len(got)), key=lambda k: (got["item_id"][k].as_py(), got["set"][k].as_py()))
    pick = lambda c: [got[c][k].as_py() for k in order]
    return ItemIndex(pick("item_id"), [np.frombuffer(x, np.uint64) for x in pick("set")], [t.encode() for t in pick("text")], pick("words"))


def _hits(index: ItemIndex, column: pa.Array, threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, shingles of the item, shared ones) found in a batch of texts."""
    for lo, hi, data, offsets, words, h, first in _shingles(column):
        docs, found = index.search(words, h, first)
        at, own = -1, {}
        for d, k in zip(docs.tolist(), found.tolist()):
            if d != at:
                at, own = d, {}
            n = min(index.lengths[k], SHINGLE_WORDS)
            if n not in own:
                own[n] = word_shingles(data[offsets[d] : offsets[d + 1]].tobytes(), n)
            want = index.shingles_of(k)
            shared = len(want & own[n])
            if shared >= threshold * len(want):
                yield lo + d, k, len(want), shared


def _row(docs: DataFrame) -> Column:
    """128 bits of doc_id and text."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), F.lit(" "), F.coalesce("text", F.lit(""))))


def _salted(keys: np.ndarray, salt: int) -> np.ndarray:
    return mix64(keys ^ mix64(np.uint64([salt])))


def _item_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, set, words) -> the keys by which documents may find it, and their class: that of the item's size, or minus its number of words where that is under five."""
    for b in batches:
        for item, raw, words in zip(*(b.column(c).to_pylist() for c in range(3))):
            own = np.frombuffer(raw, np.uint64)
            q = -words if words < SHINGLE_WORDS else int(classes_of(np.array([len(own)]))[0])
            keys = np.concatenate([_salted(np.array([(own * f).min()]), q * HASHES + i) for i, f in enumerate(_FACTORS)]) if q > 0 else _salted(own, -q)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array([item] * len(keys), pa.int64()), pa.array([q] * len(keys), pa.int64())], ["key", "item", "q"])


def _doc_keys(bits, classes: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets, words, h, first in _shingles(b.column(1)):
                row = b.column(0).slice(lo, hi - lo)
                every = [(doc, _salted(two, q * HASHES + i)) for q, i, doc, two in minima(h, first, [q for q in classes if q > 0])]
                for q in classes:
                    if q <= 0:
                        runs, of = shingles(words, -q or SHINGLE_WORDS)
                        every.append((of, _salted(runs, -q)))
                for doc, key in every:
                    key = key.view(np.int64)
                    hit = np.flatnonzero(passes(bits.value, key))
                    if len(hit):
                        keep = np.unique(np.stack([doc[hit], key[hit]]), axis=1)
                        yield pa.RecordBatch.from_arrays([row.take(pa.array(keep[0])), pa.array(keep[1])], ["row", "key"])

    return run


def _verified(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, doc, text, items in zip(*(b.column(c).to_pylist() for c in range(4))):
                own, out = {}, []
                for i in items:
                    n = min(i["words"], SHINGLE_WORDS)
                    if n not in own:
                        own[n] = word_shingles((text or "").encode(), n)
                    want = word_shingles(i["text"].encode(), SHINGLE_WORDS)
                    shared = len(want & own[n])
                    if shared >= threshold * len(want):
                        out.append((row, doc, i["item_id"], len(want), shared, shared / len(want)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.string()] + [pa.int64()] * 4 + [pa.float64()])], ["row", "doc_id", "item_id", "n_item", "n_shared", "containment"])

    return run


def _joined(docs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Found pairs, with a hash of the document's row, by joins on MinHash keys: for a benchmark of any size."""
    spark = docs.sparkSession
    items = written(sets.withColumn("item", F.monotonically_increasing_id()), "items")
    keys = written(items.select("item", "set", "words").transform(mapped(_item_keys, "key long, item long, q long")), "item-keys")
    classes = sorted(r[0] for r in keys.select("q").distinct().collect())  # powers of two, and the few below
    bits = spark.sparkContext.broadcast(key_filter(keys.select("key")))
    rows = docs.select(_row(docs).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    offers = rows.select("row", "text").transform(mapped(_doc_keys(bits, classes), "row string, key long"))
    pairs = offers.join(keys, "key").select("row", "item").distinct()
    wanted = pairs.join(items, "item").groupBy("row").agg(F.collect_list(F.struct("item_id", "words", "text")).alias("items"))
    out = "row string, doc_id long, item_id long, n_item long, n_shared long, containment double"
    return rows.join(wanted, "row").select("row", "doc_id", "text", "items").transform(mapped(_verified(threshold), out))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of documents and the items found in them: doc_id, item_id, n_item, n_shared, containment.

    Null or blank texts, of either side, match nothing; an item of fewer than
    five words counts as one shingle and is found wherever these words follow
    each other; repeated items and repeated documents give a row each, a null
    doc_id too; empty tables give none. Texts of any length are read whole. Only
    doc_id and text of ``docs`` are read.
    """
    sets = written(item_sets(items), "sets")
    index = _index(sets)
    if index is None:
        return _joined(docs, sets, threshold).drop("row")
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(b.column(0)[r].as_py(), shared.value.item_ids[k], n, m) for r, k, n, m in _hits(shared.value, b.column(1), threshold)]
            if out:
                cols = [pa.array(c, pa.int64()) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([m / n for _, _, n, m in out], pa.float64())], ["doc_id", "item_id", "n_item", "n_shared", "containment"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(mapped(search, _FOUND))


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows in whose text some item was found, all columns as they are.

    Decided row by row: rows that share a doc_id, or have a null one, stay or go
    by their own texts; repeated rows go together. Null and blank texts stay.
    An empty table on either side leaves ``docs`` as it is.
    """
    sets = written(item_sets(items), "sets")
    index = _index(sets)
    if index is None:
        hit = _joined(docs, sets, threshold).select("row").distinct()
        key = unused("_row", docs)
        kept = docs.withColumn(key, _row(docs)).join(hit.withColumnRenamed("row", key), key, "left_anti")
        return kept.select(*(F.col(f"`{c}`") for c in docs.columns))
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fine = np.ones(len(b), bool)
            fine[[r for r, *_ in _hits(shared.value, b.column(1), threshold)]] = False
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(fine))], ["row"])

    return whole_rows(docs, keep)


ORACLE = r"""
WITH w AS (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark
), s AS (
  SELECT DISTINCT side, id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
  FROM (SELECT side, id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT id, count(*) AS n_item FROM s WHERE side = 1 AND id IN (SELECT id FROM w WHERE side = 1 AND len(ws) >= 5) GROUP BY id)
SELECT d.id AS doc_id, q.id AS item_id, any_value(n.n_item) AS n_item, count(*) AS n_shared, count(*) / any_value(n.n_item)::DOUBLE AS containment
FROM s d JOIN s q ON d.side = 0 AND q.side = 1 AND d.g = q.g JOIN n ON n.id = q.id
GROUP BY d.id, q.id HAVING count(*) >= 0.8 * any_value(n.n_item)
UNION ALL
SELECT d.id, q.id, 1, 1, 1.0 FROM w d JOIN w q ON d.side = 0 AND q.side = 1 AND len(q.ws) BETWEEN 1 AND 4
  AND contains(' ' || array_to_string(d.ws, ' ') || ' ', ' ' || array_to_string(q.ws, ' ') || ' ')
"""
