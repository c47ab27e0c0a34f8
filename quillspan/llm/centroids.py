"""Centroid clustering by annulus search, in whole numbers.

Lloyd's rounds: every vector goes to its nearest centroid, every centroid moves
to the mean of its vectors, rounded down. Two vectors are at least as far apart
as their norms, so centroids are sorted by norm, and whoever is nearest to a
vector of norm r stands in the annulus of norms within r - u and r + u for any
upper bound u of that distance. The bound is the distance to the nearer of the
two centroids next to r in norm; a binary search gives the annulus, and only
centroids in it, its edges included, are compared exactly, ties to the smaller
number.

A round is one pass over the vectors: every task sums its own vectors by
centroid, sums meet by (centroid, component) in Spark, and the driver gets the
sums alone, as many as the centroids have components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.runtime import mapped, ship, written
from quillspan.llm.whole import EXACT, MOST, SLACK, ints, matrices, norms, packed

CENTROIDS, ROUNDS, SCALE, DIM, SEED = 8, 10, 1024.0, 64, "3"
#: Components of all centroids together that every task holds at most (eight bytes each).
MOST_COMPONENTS = 1 << 23
#: Sums go in digits of this size, so that they are exact whatever their size.
_DIGIT = 1 << 62


def _prepare(scale: float, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), packed(b.column(1), scale, dim)[0]], ["vec_id", "raw"])

    return run


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to the vector or vectors ``c``: doubles where they are exact, else Python integers."""
    if (np.abs(x).max(initial=0.0) + np.abs(c).max(initial=0.0)) ** 2 * x.shape[1] < EXACT:
        return ((x - c) ** 2).sum(1)
    return ((ints(x) - ints(c)) ** 2).sum(1)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of ``centres`` for each row of ``x``, and the squared distance (whole numbers as doubles, or Python integers); ties to the smaller number."""
    with np.errstate(over="ignore"):
        r, own = norms(x), norms(centres)
    order = np.argsort(own, kind="stable")
    rising = own[order]
    above = np.searchsorted(rising, r)
    bound = np.full(len(x), np.inf)
    for side in (above - 1, above):
        guess = order[np.clip(side, 0, len(order) - 1)]
        with np.errstate(over="ignore", invalid="ignore"):
            bound = np.fmin(bound, norms(x - centres[guess]))
    room = bound * SLACK + (r + bound) * (SLACK - 1)
    first, last = np.searchsorted(rising, r - room), np.searchsorted(rising, r + room, "right")
    best, square = np.full(len(x), -1), np.zeros(len(x), object)
    fast = (np.abs(x).max(initial=0.0) + np.abs(centres).max(initial=0.0)) ** 2 * x.shape[1] < EXACT
    if fast:
        square = np.zeros(len(x))
    for j in range(int(first.min(initial=len(order))), int(last.max(initial=0))):
        of = np.flatnonzero((first <= j) & (j < last))
        if not len(of):
            continue
        d, number = _squares(x[of], centres[order[j]]), order[j]
        less = (best[of] < 0) | (d < square[of]) | ((d == square[of]) & (number < best[of]))
        best[of[less]], square[of[less]] = number, d[less]
    return best, square


def _numbers(raw: pa.Array, dim: int) -> np.ndarray:
    return next(m for _, _, m in matrices(raw.to_pylist(), np.full(len(raw), dim)))


def _summed(centres, dim: int):
    """(vec_id, raw) -> what each task's vectors of each centroid add up to: cluster, component (-1: their number), digit, value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = centres.value
        sums, count = np.zeros(held.shape, object), np.zeros(len(held), np.int64)
        for b in batches:
            if not len(b):
                continue
            x = _numbers(b.column(1), dim)
            own, _ = nearest(x, held)
            plain = np.abs(x).max(initial=0.0) * len(x) < EXACT
            for c in np.unique(own).tolist():
                part = x[own == c]
                sums[c] += ints(part.sum(0)) if plain else ints(part).sum(0)
                count[c] += len(part)
        out: list[tuple[int, int, int, int]] = []
        for c in np.flatnonzero(count).tolist():
            out.append((c, -1, 0, int(count[c])))
            for i, v in enumerate(sums[c]):
                sign, v, digit = (-1 if v < 0 else 1), abs(int(v)), 0
                while v:
                    out.append((c, i, digit, sign * (v % _DIGIT)))
                    v, digit = v // _DIGIT, digit + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.array([o[0] for o in out], np.int32), np.array([o[1] for o in out], np.int32), np.array([o[2] for o in out], np.int32), np.array([o[3] for o in out], np.int64))], ["cluster", "component", "digit", "value"])

    return run


def _placed(centres, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                own, square = nearest(_numbers(b.column(1), dim), centres.value)
                distance = square.astype(np.int64) if square.dtype != object else np.array([min(int(d), MOST) for d in square], np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return run


def _moved(vectors: DataFrame, centres: np.ndarray) -> np.ndarray:
    """Centroids after a round: the mean of each one's vectors, rounded down; one without vectors stays."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)
    parts = vectors.transform(mapped(_summed(shared, centres.shape[1]), "cluster int, component int, digit int, value long"))
    rows = parts.groupBy("cluster", "component", "digit").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    count = {r["cluster"]: int(r["value"]) for r in rows if r["component"] < 0}
    sums = {c: [0] * centres.shape[1] for c in count}
    for r in rows:
        if r["component"] >= 0:
            sums[r["cluster"]][r["component"]] += int(r["value"]) * _DIGIT ** r["digit"]
    out = centres.copy()
    for c, n in count.items():
        out[c] = [float(s // n) for s in sums[c]]
    shared.unpersist()
    return out


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, scale: float = SCALE, dim: int = DIM, seed: str = SEED) -> DataFrame:
    """One row per usable row of ``vectors`` (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    A component x counts as floor(``scale`` * x). Usable are vectors of exactly
    ``dim`` components, none null or non-finite (nor beyond a double once
    multiplied); others have no row. Centroids start as the ``k`` vectors with
    the smallest lowercase-hex SHA-256 of ``<seed>:<vec_id>``, numbered in that
    order, ties by the numbers themselves; a null vec_id comes last. With fewer
    vectors there are as many centroids. After ``rounds`` rounds vectors are
    assigned once more, and that is what the rows say: squared distance, its sum
    over the cluster and over all, and the SHA-256 of the final centroid's
    components in decimal, joined by commas. Distances and sums beyond 64 bits
    are shown as the largest long; centroids whose components are beyond 2**53
    are kept to the precision of a double.

    Repeated rows count each, ties go to the smaller centroid; other columns are
    not read; an empty table gives an empty result.
    """
    if k * dim > MOST_COMPONENTS:
        raise ValueError(f"{k} centroids of {dim} components are more than the {MOST_COMPONENTS} components that every task may hold")
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = written(rows.transform(mapped(_prepare(scale, dim), "vec_id long, raw binary")).where("raw IS NOT NULL"), "whole", wide=True)
    draw = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(draw.asc_nulls_last(), "raw").limit(k).select("raw").toArrow()["raw"].combine_chunks()
    if not len(first):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centres = _numbers(first, dim)
    for _ in range(rounds):
        centres = _moved(rows, centres)
    out = written(rows.transform(mapped(_placed(spark.sparkContext.broadcast(centres), dim), "vec_id long, cluster int, distance long")), "placed", wide=True)
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = out.groupBy("cluster").agg(total.alias("own")).toArrow().to_pylist()
    told = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centres.tolist()]
    every = sum(int(r["own"]) for r in sums)
    table = spark.createDataFrame([(r["cluster"], min(int(r["own"]), MOST), min(every, MOST), told[r["cluster"]]) for r in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # a row a centroid


def oracle() -> str:
    """SQL of the rounds for the default numbers, one after the other."""
    nearest_ = """SELECT vec_id, c, d FROM (SELECT x.vec_id, m.c, sum((x.v - m.v) * (x.v - m.v))::BIGINT AS d FROM x JOIN {m} m USING (i) GROUP BY x.vec_id, m.c)
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1"""
    mean = "(s - ((s % n) + n) % n) // n"
    steps = []
    for r in range(ROUNDS):
        steps.append(f"a{r} AS MATERIALIZED ({nearest_.format(m=f'm{r}')})")
        steps.append(f"""m{r + 1} AS MATERIALIZED (SELECT m.c, m.i, coalesce(t.v, m.v) AS v FROM m{r} m LEFT JOIN (
  SELECT c, i, ({mean})::BIGINT AS v FROM (SELECT a.c, x.i, sum(x.v)::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{r} a JOIN x USING (vec_id) GROUP BY ALL)) t USING (c, i))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda e: floor({SCALE:.0f} * e::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), x AS MATERIALIZED (SELECT vec_id, unnest(generate_series(1, {DIM})) AS i, unnest(v) AS v FROM kept),
m0 AS MATERIALIZED (
  SELECT c, unnest(generate_series(1, {DIM})) AS i, unnest(v) AS v
  FROM (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1)::INT AS c, v FROM kept QUALIFY c < {CENTROIDS})
), {", ".join(steps)},
last AS MATERIALIZED ({nearest_.format(m=f"m{ROUNDS}")}),
told AS (SELECT c, sha256(string_agg(v::VARCHAR, ',' ORDER BY i)) AS h FROM m{ROUNDS} GROUP BY c)
SELECT vec_id, c AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, h AS centroid_sha256 FROM last JOIN told USING (c)
"""


ORACLE = oracle()
