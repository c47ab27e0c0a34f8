"""Hard negatives by norm-bucketed search.

Anchors look for their positives (rows of the same label with the largest inner
products) and then, for each positive, for negatives: rows of another label
whose inner product lies in a window below the positive's. Both are searches for
the best k rows within windows of scores, one window wide open for positives,
one a distinct positive score for negatives.

Rows are sorted by norm, the longest first, and cut into buckets. No row of a
bucket reaches a higher score with an anchor than the product of the anchor's
norm and the bucket's largest (Cauchy-Schwarz), so a bucket is passed over by
every anchor for which that bound is below what its windows still need: the
window's lower limit or the running k-th score, whichever is higher. Buckets
come in waves of growing number; after each wave the best rows of all buckets
are merged, and the next wave meets only anchors that still need it. Within a
bucket the same bound is tested for every chunk of rows with the running scores.

A block of anchors and a bucket meet in one task: anchors are held, rows stream
past. Blocks and buckets have a fixed number of rows, so nothing depends on how
labels, copies or sources are spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.llm.runtime import discard, few, mapped, ship, written
from quillspan.llm.whole import LEAST, MOST, SLACK, inner, matrices, packed

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256.0, 5, 5, 80, 100
#: Rows of a bucket, anchors of a block, rows and anchors of one product.
BUCKET, BLOCK, CHUNK, TILE = 8192, 8192, 2048, 512
#: Largest norms (8 bytes each) that every task of a search holds at most; with more rows buckets grow.
MOST_BUCKETS = 1 << 20
#: Pairs of bucket and block that are broadcast at most; beyond it they are joined.
BROADCAST_PAIRS = 100_000
#: A wave has so many times the buckets of the one before.
WAVE = 16
_LOWEST = -(1 << 63)
_ROW = "id long, label long, anchor boolean, raw binary, dim int, norm double"


def _prepare(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, norm = packed(b.column(3), scale)
            dim = b.column(3).value_lengths()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), raw, dim, pa.array(norm)], ["id", "label", "anchor", "raw", "dim", "norm"])

    return run


def _offers(reach: np.ndarray, first: int):
    """(id, row, ...) of anchors with norm and need -> bucket added, a row for each bucket from ``first`` on whose bound isn't below the need. ``reach`` falls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rising = -reach
        for b in batches:
            norm, need = b.column("norm").to_numpy(), b.column("need").to_numpy().astype(np.float64)
            with np.errstate(all="ignore"):
                least = np.maximum(need, 0) / (norm * SLACK) / SLACK
            n = np.where(need <= 0, len(reach), np.searchsorted(rising, -least, "right"))
            of = np.repeat(np.arange(len(b)), n)
            bucket = first + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            rows = b.take(pa.array(of))
            for lo in range(0, len(of), 1000):
                part = rows.slice(lo, 1000)
                yield pa.RecordBatch.from_arrays([pa.array(bucket[lo : lo + 1000]), *part.columns], ["bucket", *part.schema.names])

    return run


class _Block:
    """Anchors of a block and the best rows that one bucket has shown them, for each of their windows."""

    def __init__(self, rows: pa.Table, same: bool, k: int):
        take = lambda c: rows[c].to_numpy()
        self.same, self.k = same, k
        self.id, self.row, self.label, self.norm = take("id"), take("row"), take("label"), take("norm")
        windows = rows["upper"].to_pylist()
        self.number = np.array([len(x) for x in windows])
        shape = (len(windows), int(self.number.max(initial=0)))
        self.upper, self.floor = np.full(shape, LEAST), np.full(shape, MOST)
        inside = np.arange(shape[1]) < self.number[:, None]
        self.upper[inside] = np.concatenate(windows)
        self.floor[inside] = np.concatenate(rows["floor"].to_pylist())
        self.score, self.best, self.best_row = np.full((*shape, k), LEAST), np.zeros((*shape, k), np.int64), np.zeros((*shape, k), np.int64)
        self.have = np.zeros(shape, np.int64)
        self.parts = {n: (of, m) for n, of, m in matrices(rows["raw"].to_pylist(), take("dim"))}

    def meet(self, rows: pa.RecordBatch) -> None:
        ids, row, label, norm, dims = (rows.column(c).to_numpy() for c in ("id", "row", "label", "norm", "dim"))
        for n, of, m in matrices(rows.column("raw").to_pylist(), dims):
            if n not in self.parts:
                continue
            anchors, own = self.parts[n]
            for lo in range(0, len(of), CHUNK):
                at = of[lo : lo + CHUNK]
                with np.errstate(over="ignore", invalid="ignore"):
                    alive = np.flatnonzero(~(self.norm[anchors] * norm[at].max() * SLACK < self.floor[anchors].min(1)))
                for s in range(0, len(alive), TILE):
                    mine = anchors[alive[s : s + TILE]]
                    score = inner(own[alive[s : s + TILE]], m[lo : lo + CHUNK])
                    good = (score >= self.floor[mine].min(1)[:, None]) & ((self.label[mine][:, None] == label[at]) == self.same)
                    i, j = np.nonzero(good)
                    self.take(mine[i], ids[at[j]], row[at[j]], score[i, j])

    def take(self, a: np.ndarray, ids: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        other = (ids != self.id[a]) | (row != self.row[a])
        for w in range(self.upper.shape[1]):
            fits = np.flatnonzero(other & (score <= self.upper[a, w]) & (score >= self.floor[a, w]))
            if not len(fits):
                continue
            who = np.unique(a[fits])
            i, slot = np.nonzero(np.arange(self.k) < self.have[who, w][:, None])
            old = who[i]
            x = np.concatenate([a[fits], old])
            s, d, r = (np.concatenate(c) for c in ((score[fits], self.score[old, w, slot]), (ids[fits], self.best[old, w, slot]), (row[fits], self.best_row[old, w, slot])))
            order = np.lexsort((r, d, ~s, x))
            x, s, d, r = x[order], s[order], d[order], r[order]
            start = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            rank = np.arange(len(x)) - np.repeat(start, np.diff(np.append(start, len(x))))
            top = rank < self.k
            x, s, d, r, rank = x[top], s[top], d[top], r[top], rank[top]
            self.score[x, w, rank], self.best[x, w, rank], self.best_row[x, w, rank] = s, d, r
            self.have[who, w] = np.bincount(np.searchsorted(who, x), minlength=len(who))
            full = who[self.have[who, w] == self.k]
            self.floor[full, w] = np.maximum(self.floor[full, w], self.score[full, w, -1])

    def found(self) -> pa.RecordBatch:
        a, w, slot = np.nonzero(np.arange(self.k) < self.have[:, :, None])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (self.id[a], self.row[a], w.astype(np.int32), self.score[a, w, slot], self.best[a, w, slot], self.best_row[a, w, slot])], ["a", "a_row", "w", "score", "id", "row"])


def _search(same: bool, k: int):
    """Rows in order of (bucket, block, anchors first, falling norm) -> the best rows of each bucket for its anchors' windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, waiting, block = None, [], None
        for b in batches:
            bucket, part, asked = (b.column(c).to_numpy() for c in ("bucket", "block", "asked"))
            cuts = np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]) | (asked[1:] != asked[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(b)]):
                here, rows = (bucket[lo], part[lo]), b.slice(lo, hi - lo)
                if here != at:
                    if block is not None:
                        yield block.found()
                    at, waiting, block = here, [], None
                if not asked[lo]:
                    waiting.append(rows)
                    continue
                if block is None and waiting:
                    block, waiting = _Block(pa.Table.from_batches(waiting).combine_chunks(), same, k), []
                if block is not None:
                    block.meet(rows)
        if block is not None:
            yield block.found()

    return run


_ANCHOR = ["a", "a_row"]


def _best(buckets: DataFrame, reach: np.ndarray, anchors: DataFrame, windows: DataFrame, same: bool, k: int) -> DataFrame:
    """The ``k`` best rows within each window: a, a_row, w, score, id, row, rank. ``windows``: a, a_row, w, lower, upper."""
    merged = Window.partitionBy(*_ANCHOR, "w").orderBy(F.desc("score"), "id", "row")
    best, at, many = None, 0, 1
    while at < len(reach):
        to = min(len(reach), at + many)
        open_ = windows
        if best is not None:
            kth = best.groupBy(*_ANCHOR, "w").agg(F.when(F.count("*") == k, F.min("score")).alias("kth"))
            open_ = windows.join(kth, [*_ANCHOR, "w"], "left").withColumn("lower", F.greatest("lower", "kth"))
        state = open_.groupBy(*_ANCHOR).agg(F.sort_array(F.collect_list(F.struct("w", "upper", F.col("lower").alias("floor")))).alias("windows"), F.min("lower").alias("need"))
        state = anchors.join(state, (F.col("a") == F.col("id")) & (F.col("a_row") == F.col("row")))
        state = state.select("block", "id", "row", "label", "raw", "dim", "norm", "need", F.col("windows.upper").alias("upper"), F.col("windows.floor").alias("floor"))
        asking = written(state.transform(mapped(_offers(reach[at:to], at), "bucket long, block long, id long, row long, label long, raw binary, dim int, norm double, need long, upper array<long>, floor array<long>")), "anchors", wide=True)
        if asking.isEmpty():
            break
        pairs = asking.select("bucket", "block").distinct()
        rows = buckets.where(F.col("bucket").between(at, to - 1)).join(F.broadcast(pairs) if few(pairs, BROADCAST_PAIRS) else pairs, "bucket")
        none = F.lit(None).cast("array<long>")
        columns = ["bucket", "block", "asked", "id", "row", "label", "raw", "dim", "norm", "upper", "floor"]
        both = asking.withColumn("asked", F.lit(0)).select(*columns).unionByName(rows.withColumns({"asked": F.lit(1), "upper": none, "floor": none}).select(*columns))
        dealt = both.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "asked", F.desc("norm"))
        new = dealt.transform(mapped(_search(same, k), "a long, a_row long, w int, score long, id long, row long"))
        new = written(new, "met", wide=True)
        every = new if best is None else new.unionByName(best.drop("rank"))
        fresh = written(every.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= k), "best")
        discard(asking, new, best)
        best, at, many = fresh, to, many * WAVE
    return best


def _share(score: str, per_cent: int, up: bool) -> Column:
    """``per_cent`` (0 to 100) hundredths of a long that isn't negative, rounded up or down, without overflow."""
    return F.expr(f"{per_cent} * ({score} div 100) + ({per_cent} * ({score} % 100) + {99 if up else 0}) div 100")


def mined(vectors: DataFrame, anchor: Column, label: Column | None = None, scale: float = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Hard negatives of the rows of ``vectors`` (vec_id, embedding, label) for which ``anchor`` holds: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A component x counts as floor(``scale`` * x), a score is the exact inner
    product; scores fall, ties by vec_id. An anchor's positives are its first
    ``positives`` other rows of the same label; the negatives of each are the
    first ``negatives`` rows of another label whose score is between ``low``
    and ``high`` (0 to 100) hundredths of the positive's. Fewer where there are
    no more; an anchor without any gives no row.

    Rows with a null label, a null vector or a null or non-finite component take
    no part, nor does one whose product with ``scale`` is beyond a double.
    Vectors of different lengths don't meet. A score beyond 64 bits counts as
    the nearest number of 64 bits. Rows alike in vec_id, label and whole numbers
    count once; rows that share only a vec_id are rows of their own, and so may
    give results alike in all ids. A null vec_id is an id below all others, and
    null in the result; a null ``anchor`` counts as false. Other columns are not
    read; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    own = F.col("label") if label is None else label
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(_LOWEST)).alias("id"), own.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("label IS NOT NULL AND embedding IS NOT NULL").transform(mapped(_prepare(scale), _ROW)).where("raw IS NOT NULL")
    rows = written(rows.withColumn("row", F.xxhash64("label", "raw")), "whole", wide=True)
    n = rows.count()
    if not rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        once = written(rows.dropDuplicates(["id", "row"]), "whole", wide=True)
        discard(rows)
        rows = once
    size = max(BUCKET, -(-n // MOST_BUCKETS))
    dealt = rows.repartitionByRange(max(1, -(-n // size)), F.desc("norm"), F.xxhash64("id"), "row").sortWithinPartitions(F.desc("norm"))
    buckets = written(dealt.withColumn("bucket", F.spark_partition_id().cast("long")), "buckets", wide=True)
    reach = buckets.groupBy("bucket").agg(F.max("norm").alias("norm")).orderBy("bucket").toPandas()
    most = np.zeros(int(reach["bucket"].max()) + 1 if len(reach) else 0)  # of a bucket without rows: that of the next
    most[reach["bucket"].to_numpy(np.int64)] = reach["norm"].to_numpy(np.float64)
    most = np.maximum.accumulate(most[::-1])[::-1]
    anchors = rows.where("anchor")
    blocks = max(1, -(-anchors.count() // BLOCK))
    anchors = written(anchors.withColumn("block", F.pmod(F.xxhash64("id", "row"), F.lit(blocks))), "asking", wide=True)
    columns = [F.col("id").alias("a"), F.col("row").alias("a_row")]
    wide_open = anchors.select(*columns, F.lit(0).alias("w"), F.lit(LEAST).alias("lower"), F.lit(MOST).alias("upper"))
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    found = _best(buckets, most, anchors, wide_open, True, positives)
    if found is None:
        return empty
    limits = found.where("score >= 0").select(*_ANCHOR, F.col("score").alias("positive_score")).distinct()  # a negative score's window is empty
    limits = limits.withColumns({"lower": _share("positive_score", low, True), "upper": _share("positive_score", high, False)}).where("lower <= upper")
    place = Window.partitionBy(*_ANCHOR).orderBy(F.desc("positive_score"))
    windows = written(limits.withColumn("w", F.row_number().over(place) - 1), "windows")
    best = _best(buckets, most, anchors, windows, False, negatives)
    if best is None:
        return empty
    shown = lambda c: F.when(F.col(c) != _LOWEST, F.col(c))
    hard = best.select(*_ANCHOR, "w", "rank", F.col("id").alias("negative"), F.col("score").alias("negative_score")).join(windows.select(*_ANCHOR, "w", "positive_score"), [*_ANCHOR, "w"])
    out = found.select(*_ANCHOR, F.col("id").alias("positive"), F.col("score").alias("positive_score")).join(hard, [*_ANCHOR, "positive_score"])
    return out.select(shown("a").alias("anchor_id"), shown("positive").alias("positive_id"), F.col("rank").cast("int").alias("rank"), shown("negative").alias("negative_id"), "positive_score", "negative_score")


def relabelled() -> Column:
    """The label of ``op12``: every seventh id has the next one."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id))::INT AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) <= 5
"""
