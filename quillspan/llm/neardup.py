"""MinHash near-dedup with tensored banding.

A document is the set of its distinct shingles (ASCII lower case), of two words
unless told otherwise.
Documents with equal sets are one class; only classes are compared.

Tables. Two collections of ``HALVES`` sketches of ``ROWS`` minima each; the key of
table (i, j) is the pair of sketch i of the first and sketch j of the second
collection: HALVES**2 tables of 2 * ROWS minima out of 2 * HALVES * ROWS
minima in all. At a similarity of 0.8 a pair shares a table with a
probability of (1 - (1 - 0.8**3)**12)**2 = 0.9996, at 0.85 of 0.99998.

Candidates. Within a table bucket all members are first compared with one of
them (a leader), not with each other. What links joins a component. Buckets
that still hold several components are compared anew the same way, and in the
end every id is compared, block by block, with the ids of other components that
share a bucket with it. So no pair that some table offers goes unanswered,
though pairs are never listed. Each batch of classes first gives its members of
a bucket a leader of their own, so a bucket that holds a third of all classes
gets a row for each batch, not for each class.

Links are verified on the full sets of the full texts, at last on the words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.components import components
from quillspan.llm.runtime import mapped, mix64, narrowed, ship, unused, without, written
from quillspan.llm.words import distinct_shingles, split_words, texts, word_shingles

HALVES, ROWS = 12, 3
THRESHOLD, SHINGLE_WORDS, STAR_ROUNDS = 80, 2, 3
#: A block has about so many shingles at most (eight bytes each), and as many ids as four times the root of its star, within these bounds: so copies grow with the power 1.5 of a family.
BLOCK_SHINGLES, BLOCK, MOST_BLOCK = 1 << 18, 256, 4096
_FACTORS = np.random.Generator(np.random.PCG64(906)).integers(1, 2**63, 2 * HALVES * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWEST = -(1 << 63)


def sketches(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sketches of both collections, a row of 32-bit integers a document; ``first`` must not hold empty documents."""
    if len(first) < 2:
        return np.zeros((0, 2 * HALVES), np.int32)
    out = np.zeros((len(first) - 1, 2 * HALVES), np.uint64)
    for i, f in enumerate(_FACTORS):
        out[:, i // ROWS] = mix64(out[:, i // ROWS] * np.uint64(3) + np.minimum.reduceat(h * f, first[:-1]))
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketch(shingle_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in texts(b.column(1)):
                h, of = distinct_shingles(split_words(data, offsets, lower=True), shingle_words)
                first = np.searchsorted(of, np.arange(hi - lo + 1))
                n = np.diff(first)
                some = np.flatnonzero(n)
                rows = sketches(h, np.append(first[some], len(h)))
                one, two = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
                if len(some):
                    one[some] = np.add.reduceat(mix64(h), first[some])
                    two[some] = np.add.reduceat(mix64(h ^ np.uint64(0x5851F42D4C957F2D)), first[some])
                sketch = [None] * (hi - lo)
                for k, r in zip(some.tolist(), rows):
                    sketch[k] = r.tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(2)[lo:hi], pa.array(n, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(sketch, pa.binary())], ["doc_id", "row", "n", "s1", "s2", "sketch"])

    return run


_ALONE, _LEADS, _FOLLOWS = 0, 1, 2


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, sketch) -> a row for each table: key, id, the batch's own leader of the key, and whether the row is alone there, leads or follows."""
    table = np.arange(HALVES * HALVES)
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        rows = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(len(ids), 2 * HALVES).astype(np.uint64)
        order = np.argsort(ids)
        for lo in range(0, len(ids), 2000):
            part = order[lo : lo + 2000]
            pairs = (rows[part][:, table // HALVES] << np.uint64(32)) | rows[part][:, HALVES + table % HALVES]
            key = (mix64(pairs) ^ mix64(table.astype(np.uint64))).ravel()
            own = np.repeat(ids[part], len(table))
            by = np.argsort(key, kind="stable")
            key, own = key[by], own[by]
            new = np.ones(len(key) + 1, bool)
            new[1:-1] = key[1:] != key[:-1]
            lead = own[np.maximum.accumulate(np.where(new[:-1], np.arange(len(key)), 0))]
            state = np.where(new[:-1], np.where(new[1:], _ALONE, _LEADS), _FOLLOWS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(own), pa.array(lead), pa.array(state)], ["key", "id", "leader", "state"])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (key, id) -> those of keys that several ids have, with a leader: of the rows that don't follow already, the first id of the key. One row is held back at a time."""
    names = ["key", "id", "leader"]
    held, carry, before = None, 0, False  # the row held back, its leader, whether a row with its key came before
    for b in batches:
        key, ids, lead, state = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        done = state == _FOLLOWS
        if done.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[done]) for x in (key, ids, lead)], names)
            key, ids, state = key[~done], ids[~done], state[~done]
        if held is not None:
            key, ids, state = (np.append(x, y) for x, y in zip(held, (key, ids, state)))
        if not len(key):
            continue
        same = np.append(before, key[1:] == key[:-1])
        start = np.maximum.accumulate(np.where(np.append(False, same[1:]), 0, np.arange(len(key))))
        first = np.where(start == 0, carry if held is not None else ids[0], ids[start])
        keep = same[:-1] | same[1:] | (state[:-1] == _LEADS)
        yield pa.RecordBatch.from_arrays([pa.array(x[:-1][keep]) for x in (key, ids, first)], names)
        held, carry, before = [x[-1:] for x in (key, ids, state)], first[-1], bool(same[-1])
    if held is not None and (before or held[2][0] == _LEADS):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (held[0], held[1], np.array([carry]))], names)


def _verify(threshold: int, shingle_words: int):
    def alike(shared: int, p: int, q: int) -> bool:
        return shared > 0 and 100 * shared >= threshold * (p + q - shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets(column):
            for lo, hi, data, offsets in texts(column):
                h, of = distinct_shingles(split_words(data, offsets, lower=True), shingle_words)
                yield from np.split(h, np.searchsorted(of, np.arange(1, hi - lo)))

        for b in batches:
            ok = []
            for i, (p, q) in enumerate(zip(sets(b.column(2)), sets(b.column(3)))):
                if near := alike(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q)):
                    u, v = (word_shingles(b.column(c)[i].as_py().encode(), shingle_words) for c in (2, 3))
                    near = alike(len(u & v), len(u), len(v))
                ok.append(near)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ok, pa.bool_())], ["x", "y", "linked"])

    return run


def verified(pairs: DataFrame, rows: DataFrame, threshold: int, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``pairs`` (x, y) with ``linked``: similarity of the full sets, at last of the words themselves. ``rows`` has id and text. Only texts that take part are moved."""
    out = pairs
    for c in ("x", "y"):
        side = narrowed(rows, "id", pairs.select(c)).select(F.col("id").alias(f"_{c}"), F.col("text").alias(f"text_{c}"))
        out = out.join(side, F.col(c) == F.col(f"_{c}")).drop(f"_{c}")
    return out.select("x", "y", "text_x", "text_y").transform(mapped(_verify(threshold, shingle_words), "x long, y long, linked boolean"))


def _row(docs: DataFrame) -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), "text", F.col("text").isNull())


def _grouped(docs: DataFrame, threshold: int, shingle_words: int) -> tuple[DataFrame, bool]:
    """Of each row of ``docs``: id, doc_id, n, component (an id of its group, alike for all of it); and whether ids are the doc_ids.

    Ids are the doc_ids where all are there and none repeats; else they are
    hashes of doc_id and text, so that every other row is a document of its own.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row(docs).alias("row"), "text")
    each = written(rows.select("doc_id", "text", "row").transform(mapped(_sketch(shingle_words), "doc_id long, row long, n long, s1 long, s2 long, sketch binary")), "sketches", wide=True)
    plain = each.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty()
    each = each.withColumn("id", F.col("doc_id" if plain else "row")).drop("row")
    rows = rows.select(F.col("doc_id" if plain else "row").alias("id"), "text")
    if not plain:
        again = each.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
        if not again.isEmpty():  # rows alike in doc_id and text: one stands for all
            again = written(again, "again")
            one = narrowed(rows, "id", again).join(again, "id", "left_semi").dropDuplicates(["id"])
            rows = written(without(rows, "id", again).unionByName(one), "distinct", wide=True)
    same = ["n", "s1", "s2"]
    classes = written(each.where("n > 0").groupBy(*same).agg(F.min("id").alias("class"), F.first("sketch").alias("sketch")), "classes", wide=True)
    keys = classes.select("class", "sketch").transform(mapped(_keys, "key long, id long, leader long, state int"))
    deal = F.when(F.col("state") == _FOLLOWS, F.xxhash64("key", "id")).otherwise(F.xxhash64("key"))
    shared = written(keys.repartition(deal).sortWithinPartitions("key", "id").transform(mapped(_shared, "key long, id long, leader long")), "buckets", wide=True)

    links, labels = None, None
    for turn in range(STAR_ROUNDS + 1):
        if turn == 0:
            offers = shared.where("id <> leader").groupBy(F.col("id").alias("x"), F.col("leader").alias("y")).agg(F.count("*").alias("k"))
        else:
            of = labels.select("id", "component")
            members = shared.select("key", "id").join(of, "id", "left").withColumn("component", F.coalesce("component", "id"))
            mixed = members.groupBy("key").agg(F.min(F.struct("component", "id")).alias("lead"), F.max("component").alias("most")).where("lead.component < most")
            mixed = written(members.join(mixed, "key"), "mixed")
            if mixed.isEmpty():
                break
            offers = mixed.where("component <> lead.component").groupBy(F.col("id").alias("x"), F.col("lead.id").alias("y")).agg(F.count("*").alias("k"))
        if turn == STAR_ROUNDS:
            pairs = _remaining(shared, mixed, labels, classes.select(F.col("class").alias("id"), "n"), rows, threshold, shingle_words)
        else:
            best = Window.partitionBy("x").orderBy(F.desc("k"), "y")
            pairs = offers.withColumn("r", F.row_number().over(best)).where("r = 1").select("x", "y")
        pairs = written(pairs, "pairs", heavy=turn == STAR_ROUNDS)
        if pairs.isEmpty():
            break
        more = written(verified(pairs, rows, threshold, shingle_words).where("linked").select("x", "y"), "found", heavy=True)
        links = more if links is None else links.unionByName(more)
        labels = written(components(links), "labels")
    each = each.select("id", "doc_id", *same).join(classes.select("class", *same), same, "left")
    if labels is not None:
        each = each.join(labels.select(F.col("id").alias("class"), "component"), "class", "left")
    else:
        each = each.withColumn("component", F.lit(None).cast("long"))
    return each.select("id", "doc_id", "n", F.coalesce("component", "class", "id").alias("component")), plain


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Null, empty and blank texts have no shingles and link with nothing; a text
    of fewer than ``shingle_words`` words has all of them as its only shingle.
    Every row is a document of its own, whether its doc_id repeats or is null;
    rows alike in both doc_id and text are one. A null doc_id is an id below all
    others, and null in the result. Texts of any length are read whole; other
    columns are not read; an empty table gives an empty result.
    """
    each, plain = _grouped(docs, threshold, shingle_words)
    if plain:
        out = each.withColumn("least", F.col("component"))
    else:
        each = written(each, "groups")
        own = F.coalesce("doc_id", F.lit(_LOWEST))
        least = each.groupBy("component").agg(F.min(own).alias("least"))
        out = each.join(least, "component").withColumn("doc_id", own)
    shown = lambda c: F.when(c != _LOWEST, c) if not plain else c
    return out.select(shown(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), shown(F.col("least")).alias("component_id"), (F.col("doc_id") == F.col("least")).alias("kept"))


def _remaining(shared: DataFrame, mixed: DataFrame, labels: DataFrame, sizes: DataFrame, rows: DataFrame, threshold: int, shingle_words: int) -> DataFrame:
    """Pairs of ids, of components that still share a bucket, whose sets are alike: x, y.

    Ids that have the same smallest bucket leader, or leader's leader and so on, form a star; stars are cut
    into blocks (``BLOCK``). An id probes the stars that hold an id
    of a component below its own in one of its buckets, there all blocks that
    hold such a component (buckets are met by star, since a family's members
    share dozens of them); it is then compared with all such ids of the block at
    once. A block that many probe is copied, so that about as many probes as it
    holds ids meet each copy. What leaves a block is one pair for each probe and
    component that it reaches.

    Texts become sets of shingle hashes once, and only these move: members of a
    family made from one template meet in blocks, however many there are, and no
    text goes anywhere unless a pair's sets are alike.
    """
    stars = shared.groupBy("id").agg(F.min("leader").alias("star"))
    for _ in range(2):  # a batch's own leader follows one of the whole bucket, which may follow another
        stars = written(stars, "stars")
        far = stars.select(F.col("id").alias("via"), F.col("star").alias("further"))
        stars = stars.join(far, F.col("star") == F.col("via"), "left").select("id", F.least("star", "further").alias("star"))
    stars = stars.join(labels.select("id", "component"), "id", "left").withColumn("component", F.coalesce("component", "id")).join(sizes, "id")
    ids = F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(BLOCK), 4 * F.sqrt(F.count("*"))))
    cut = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / ids)).cast("long")
    parts = stars.groupBy("star").agg(cut.alias("parts"))
    block = F.xxhash64("star", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block")
    home = written(stars.join(parts, "star").select("id", "component", "star", block), "home")
    members = mixed.select("key", "id").join(home, "id")
    least = members.groupBy("key", "star").agg(F.min("component").alias("least")).select(F.col("key").alias("k"), F.col("star").alias("to"), "least")
    reach = members.select("key", "id", "component").join(least, (F.col("key") == F.col("k")) & (F.col("least") < F.col("component")))
    reach = reach.select("id", "component", "to").distinct()
    blocks = home.groupBy(F.col("star").alias("to"), "block").agg(F.min("component").alias("lowest"), F.count("*").alias("holds"))
    probes = written(reach.join(blocks, "to").where("lowest < component").select("id", "component", "block", "holds"), "probes")
    copies = probes.groupBy("block").agg(F.ceil(F.count("*") / F.greatest(F.lit(128), F.max("holds"))).cast("long").alias("copies"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    held = home.join(copies, "block").select("id", "component", "block", every, F.lit(0).alias("probe"))
    asking = probes.join(copies, "block").select("id", "component", "block", F.pmod(F.xxhash64("id", "block"), F.col("copies")).alias("copy"), F.lit(1).alias("probe"))
    both = written(held.unionByName(asking), "blocks")
    dealt_by = ["block", "copy"]
    sets = written(narrowed(rows, "id", both.select("id")).select("id", "text").transform(mapped(_sets(shingle_words), "id long, set binary")), "sets", wide=True)
    full = both.join(sets, "id").select(*dealt_by, "probe", "id", "component", "set")
    return full.repartition(*dealt_by).sortWithinPartitions(*dealt_by, "probe").transform(mapped(_probe(threshold), "x long, y long"))


def _sets(shingle_words: int):
    """(id, text) -> the hashes of the text's shingles, ascending, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in texts(b.column(1)):
                h, text = distinct_shingles(split_words(data, offsets, lower=True), shingle_words)
                each = np.split(h, np.searchsorted(text, np.arange(1, hi - lo)))
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array([x.tobytes() for x in each], pa.binary())], ["id", "set"])

    return run


def _probe(threshold: int):
    """Rows in order of (block, copy, ids held first) -> pairs of a probe and an id whose sets are alike, one for each component below the probe's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sets, ids, component, index = None, [], [], [], None
        for b in batches:
            block, copy, probe, own, of = (b.column(c).to_numpy(zero_copy_only=False) for c in range(5))
            found: list[tuple[int, int]] = []
            for row, raw in enumerate(b.column(5)):
                mine = np.frombuffer(raw.as_buffer(), np.uint64)
                here = (block[row], copy[row])
                if here != at:
                    at, sets, ids, component, index = here, [], [], [], None
                if not probe[row]:
                    sets.append(mine.copy())
                    ids.append(own[row])
                    component.append(of[row])
                elif sets:
                    if index is None:
                        size = np.array([len(x) for x in sets])
                        every, who = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), size)
                        order = np.argsort(every)
                        index, sets = (every[order], who[order], size, np.array(ids), np.array(component)), [None]
                    every, who, size, names, groups = index
                    first, last = np.searchsorted(every, mine), np.searchsorted(every, mine, "right")
                    common = np.zeros(len(size), np.int64)
                    step = max(1, (1 << 20) // len(size))  # a shingle that all ids of the block hold counts for each of them
                    for k in range(0, len(mine), step):
                        lo, n = first[k : k + step], last[k : k + step] - first[k : k + step]
                        stop = np.cumsum(n)
                        common += np.bincount(who[np.repeat(lo - (stop - n), n) + np.arange(stop[-1])], minlength=len(size))
                    good = (100 * common >= threshold * (size + len(mine) - common)) & (common > 0) & (groups < of[row])
                    k = np.flatnonzero(good)
                    for j in k[np.unique(groups[k], return_index=True)[1]].tolist():
                        found.append((own[row], names[j]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["x", "y"])

    return run


def deduplicated(docs: DataFrame, threshold: int = THRESHOLD, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, the one with the smallest doc_id; a null one is below all others.

    Decided row by row: rows that share a doc_id but not the text are documents
    of their own, as are rows with a null doc_id. Of rows alike in both one
    stays, also where the text has no shingles. Rows that stay are not shuffled
    but for those that the filter of removed ids can't tell from one.
    """
    each, plain = _grouped(docs, threshold, shingle_words)
    each = written(each, "groups")
    first = each.groupBy("component").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(_LOWEST)).alias("doc_id"), "id")).alias("first")).select("first.id")
    gone = written(each.select("id").distinct().join(first, "id", "left_anti"), "gone")  # by id: a component may hold a third of all rows
    key = unused("_id", docs)
    kept = without(docs.withColumn(key, F.col("doc_id").cast("long") if plain else _row(docs)), key, gone)
    if not plain:
        again = written(each.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias(key)), "again")
        if not again.isEmpty():
            one = narrowed(kept, key, again).join(again, key, "left_semi").dropDuplicates([key])
            kept = without(kept, key, again).unionByName(one)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS g
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 1))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * k >= 80 * (na.n + nb.n - k)
), both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS id, doc_id AS other FROM documents UNION SELECT r.id, l.b FROM reach r JOIN both_ways l ON r.other = l.a),
c AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
