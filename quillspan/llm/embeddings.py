"""Embedding near-dedup by lattice hashing.

Unit vectors are projected to sixteen dimensions and each half is decoded to a
point of the E8 lattice, the densest packing there is in eight dimensions;
every table has its own projection and offset, and a pair of points is the key
of its bucket. Each vector also probes the lattice cell next to it in either
half, the neighbour in the direction it leans to most. Two vectors meet where
one's own cell is among the cells the other visits. Vectors of each length have
projections of their own.

Vectors that are equal component by component are one class. A bucket of up to
``BLOCK`` classes (or a small share of all, where these are many) is compared as
it is; a pair that meets in several of them counts in the first table in which
it meets. Buckets come in waves, slices of the key space, and what a wave moved
is gone before the next one, so that disk holds each vector a few times however
many cells it visits. What meets in a larger bucket, a family of vectors that
share many, is settled on ids first: each class has one home block, a part of
the largest bucket it visits, and learns from its large buckets, once each, the
blocks in which somebody meets it. Only then vectors move, one copy for each
such block, and two blocks are compared once. What leaves a comparison is a
count for each member and which members hang together, never all pairs.
Cosines are in single precision, and in double where that leaves a doubt.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.components import components
from quillspan.llm.runtime import keep_memory, mapped, mix64, narrowed, ship, written

COSINE, TABLES, SCALE, PROBES = 0.95, 16, 0.75, 2
#: Classes in a bucket that is compared as it is: so many, or this share of all classes up to ``MOST_BUCKET``. Those in a home block are four times the root of the family within ``BLOCK`` and ``MOST_BLOCK``, so that copies grow with the power 1.5 of it.
BLOCK, BUCKET_SHARE, MOST_BUCKET, MOST_BLOCK = 256, 1 / 256, 32_768, 4096
#: Bytes that a wave moves: so many, or what ``MOST_WAVES`` leave for each. A task compares a part of its buckets of about ``PART_BYTES`` at once.
WAVE_BYTES, MOST_WAVES, PART_BYTES = 1 << 30, 48, 8 << 20
#: Classes among which large buckets are looked for, at least; beyond it enough for 64 in each.
SAMPLED = 1 << 16
#: Single precision decides a cosine that is further from the threshold than this.
DOUBT = 1e-4
_LOWEST = -(1 << 63)


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest point with integer coordinates of even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(1).astype(np.int64) & 1)
    if len(odd):
        gap = x[odd] - r[odd]
        worst = np.abs(gap).argmax(1)
        r[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest E8 point, and the nearest one of the other coset; both doubled, so that they are integers."""
    a, b = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    far = ((x - a) ** 2).sum(1) > ((x - b) ** 2).sum(1)
    best, other = np.where(far[:, None], b, a), np.where(far[:, None], a, b)
    return np.rint(2 * best).astype(np.int64), np.rint(2 * other).astype(np.int64)


def projections(dim: int, tables: int, seed: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """For each table sixteen orthonormal directions (as far as the dimension allows) and an offset."""
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.zeros((tables, dim, 16))
    for t in range(tables):
        q, _ = np.linalg.qr(rng.normal(size=(max(dim, 16), 16)))
        out[t] = q[:dim]
    return out, rng.uniform(0, 2, (tables, 16))


def _minimal() -> np.ndarray:
    """The shortest lattice vectors, doubled: (+-2, +-2, 0^6) and (+-1)^8 with an even number of minus signs."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-2, 2):
                for b in (-2, 2):
                    v = np.zeros(8, np.int64)
                    v[i], v[j] = a, b
                    out.append(v)
    for m in range(256):
        s = np.array([1 - 2 * (m >> k & 1) for k in range(8)])
        if (s < 0).sum() % 2 == 0:
            out.append(s)
    return np.array(out)


_NEIGHBOURS = _minimal()
_DIRECTIONS = np.ascontiguousarray(_NEIGHBOURS.T, np.float32)


def _cell_key(points: np.ndarray, table: int) -> np.ndarray:
    h = np.full(len(points), table + 1, np.uint64)
    for k in range(8):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + points[:, k].astype(np.uint64))
    return h.view(np.int64)


def cells(unit: np.ndarray, dim_scale: float, tables: int, probes: int) -> np.ndarray:
    """Cells each vector visits, as 32 bits that tell those of a table apart: rows x tables x (1 + probes), the own cell first, then one with a neighbour in the first half and one in the second."""
    proj, off = projections(unit.shape[1], tables)
    out = np.zeros((len(unit), tables, 1 + probes), np.uint32)
    for t in range(tables):
        x = unit @ proj[t] / dim_scale + off[t]
        halves = []
        for half in (x[:, :8], x[:, 8:]):
            best, _ = nearest_e8(half)
            lean = ((2 * half - best).astype(np.float32) @ _DIRECTIONS).argmax(1)
            halves.append([_cell_key(p, t).view(np.uint64) for p in (best, best + _NEIGHBOURS[lean])])
        (a, a_next), (b, b_next) = halves
        for k, (first, second) in enumerate(((a, b), (a_next, b), (a, b_next))[: 1 + probes]):
            out[:, t, k] = mix64(first * np.uint64(0x9E3779B97F4A7C15) + second) >> np.uint64(32)
    return out


def _keys(seen: np.ndarray) -> np.ndarray:
    """Keys of buckets, the table above the 32 bits of the cell, of rows x tables x visits."""
    return seen.astype(np.int64) | np.arange(seen.shape[1], dtype=np.int64)[None, :, None] << 32


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of the batch's vectors: positions of those that can link, and these vectors in double precision."""
    n = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    for dim in np.unique(n[n > 0]).tolist():
        at = np.flatnonzero(n == dim)
        flat = column.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(at), dim)
        fine = np.isfinite(flat).all(1) & flat.any(1)
        yield at[fine], flat[fine]


def _classes(kind, hashed: bool):
    """Each row with its components as bytes of ``kind``, or a hash of these; null where the vector can link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [None] * len(b)
            for at, v in matrices(b.column(1)):
                for i, r in zip(at.tolist(), (v + 0.0).astype(kind)):
                    raw[i] = hashlib.blake2b(r.tobytes(), digest_size=16).digest() if hashed else r.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], ["vec_id", "hash" if hashed else "raw"])

    return run


def _vectors(raw: pa.Array, kind) -> np.ndarray:
    return _units(np.frombuffer(b"".join(raw.to_pylist()), kind).reshape(len(raw), -1).astype(np.float64))


def _units(v: np.ndarray) -> np.ndarray:
    scaled = v / np.abs(v).max(1, keepdims=True)
    scaled /= np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]
    return scaled


def _visits(kind):
    """Each class with all cells it visits as bytes, table by table, and the hash of its components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(size):
                part = b.take(pa.array(np.flatnonzero(size == dim)))
                unit = _vectors(part.column(1), kind)
                seen = cells(unit, SCALE * np.sqrt(8 / unit.shape[1]), TABLES, PROBES).reshape(len(unit), -1)
                hashes = [hashlib.blake2b(r, digest_size=16).digest() for r in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([r.tobytes() for r in seen], pa.binary()), pa.array(hashes, pa.binary())], ["id", "raw", "copies", "cells", "hash"])

    return run


def _seen(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), TABLES, 1 + PROBES)


def _among(keys: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Whether keys are in a sorted array."""
    if not len(few):
        return np.zeros(keys.shape, bool)
    return few[np.minimum(np.searchsorted(few, keys), len(few) - 1)] == keys


def _listed(few: np.ndarray | None = None):
    """Rows (id, cells) -> id, key, own for all visits; with ``few`` those to its keys only. A cell that one visits twice counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = _seen(b.column(1))
            mine = np.ones(seen.shape, bool)
            for k in range(1, 1 + PROBES):
                mine[:, :, k] &= (seen[:, :, :k] != seen[:, :, k : k + 1]).all(2)
            keys = _keys(seen)
            if few is not None:
                mine &= _among(keys, few)
            row, _, visit = np.nonzero(mine)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(keys[mine]), pa.array(visit == 0)], ["id", "key", "own"])

    return run


def _marks(keys: np.ndarray, large: np.ndarray) -> np.ndarray:
    """For rows of keys of buckets a bit for each table in which the own cell is among ``large``."""
    return (_among(keys[:, :, 0], large) * _TABLE_BITS).sum(1)


def _marked(large: np.ndarray):
    """Rows (id, raw, copies, cells) with their marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_marks(_keys(_seen(b.column(3))), large))], ["id", "raw", "copies", "cells", "large"])

    return run


def _sent(kind, large: np.ndarray, wave: int, waves: int, parts: int):
    """Rows (id, raw, copies, cells) -> one for each part of the buckets and length of vectors, with all visits of the wave to buckets that aren't large as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        for b in batches:
            size = pc.binary_length(b.column(1)).to_numpy(zero_copy_only=False)
            for dim in np.unique(size):
                own = b if (size == dim).all() else b.take(pa.array(np.flatnonzero(size == dim)))
                seen = _seen(own.column(3))
                keys = _keys(seen)
                mine = (seen % np.uint32(waves) == wave) & ~_among(keys, large)
                for k in range(1, 1 + PROBES):
                    mine[:, :, k] &= (seen[:, :, :k] != seen[:, :, k : k + 1]).all(2)
                row, _, visit = np.nonzero(mine)
                key = keys[mine]
                part = (mix64(key.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                row, key, visit, part = row[order], key[order], visit[order], part[order]
                head = np.zeros(len(row), _HEAD)
                head["key"], head["own"], head["large"] = key, visit == 0, _marks(keys, large)[row]
                head["id"], head["copies"] = (own.column(i).to_numpy()[row] for i in (0, 2))
                raw, cell = np.frombuffer(b"".join(own.column(1).to_pylist()), kind).reshape(len(own), -1), seen.reshape(len(own), -1)
                new = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
                blobs = [(part[s], dim, head[s:e].tobytes(), raw[row[s:e]].tobytes(), cell[row[s:e]].tobytes()) for s, e in zip(new, np.append(new[1:], len(part)).astype(int))]
                if blobs:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blobs), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["part", "size", "head", "raw", "cells"])

    return run


def _meetings(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of classes (rows of cells; ``a`` of the smaller id): whether they meet in a large bucket, and the bucket that counts otherwise.

    They meet where one's own cell is among those the other visits. Of the
    first table in which they do, the first one's own cell counts if the second
    visits it. ``in_a`` and ``in_b`` say by table whether one's own cell is a
    large bucket.
    """
    to_a, to_b = (a[:, :, :1] == b).any(2), (b[:, :, :1] == a).any(2)
    t = (to_a | to_b).argmax(1)
    row = np.arange(len(a))
    return (to_a & in_a | to_b & in_b).any(1), np.where(to_a[row, t], a[row, t, 0], b[row, t, 0]).astype(np.int64) | t << 32


def joined(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Smallest position that hangs together with each of ``n`` by the links ``p``-``q``."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[p], label[q])
        before = label.copy()
        np.minimum.at(label, p, least)
        np.minimum.at(label, q, least)
        label = label[label]
        if (label == before).all():
            return label


_HEAD = np.dtype([("key", np.int64), ("id", np.int64), ("copies", np.int64), ("large", np.int32), ("own", bool)])
#: Buckets of up to so many members are compared all at once, neighbours in their order at growing distance.
_TINY = 16
_TABLE_BITS = np.int64(1) << np.arange(TABLES)


def _near(single: np.ndarray, least: float, new: np.ndarray, sides: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions and cosines of pairs of ``least`` at least within groups that begin at ``new``; one is of ``sides[0]``, the other of ``sides[1]``, and each pair comes once."""
    left, right = sides
    end = np.append(new[1:], len(single))
    last, many = np.repeat(end, end - new), np.repeat(end - new, end - new)
    every = np.flatnonzero((many <= _TINY) & (many > 1))
    for k in range(1, _TINY):
        every = every[every + k < last[every]]
        if not len(every):
            break
        i = every[left[every] & right[every + k] | right[every] & left[every + k]]
        for at in range(0, len(i), 2048):
            p = i[at : at + 2048]
            cosine = np.einsum("ij,ij->i", single[p], single[p + k])
            hit = cosine >= least
            yield p[hit], p[hit] + k, cosine[hit]
    for g in np.flatnonzero(end - new > _TINY).tolist():
        s, e = int(new[g]), int(end[g])
        a, b = s + np.flatnonzero(left[s:e]), s + np.flatnonzero(right[s:e])
        other = single[b].T
        step = max(16, (1 << 18) // max(1, len(b)))
        for at in range(0, len(a), step):
            cosine = single[a[at : at + step]] @ other
            i, j = np.divmod(np.flatnonzero(cosine >= least), len(b))
            p, q = a[at + i], b[j]
            once = (p < q) | ~(left[q] & right[p]) & (p != q)
            yield p[once], q[once], cosine[i[once], j[once]]


def _counted(raw: np.ndarray, group: list[np.ndarray], sides: list[np.ndarray], ids: np.ndarray, copies: np.ndarray, marks: np.ndarray, seen: np.ndarray, cosine: float, large: bool) -> Iterator[pa.RecordBatch]:
    """Counts and links among rows of vectors of one length, which stand in order of their groups.

    ``large``: groups are of two home blocks and only pairs that meet in a large
    bucket count; else they are of buckets and the others do, once.
    """
    n, lo = len(ids), group[0]
    new = np.flatnonzero(np.append(True, np.any([g[1:] != g[:-1] for g in group], axis=0)))
    if len(new) == n:
        return
    single = _units(raw).astype(np.float32, copy=False)
    links, edges = np.zeros(n, np.int64), [(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def count(i: np.ndarray, j: np.ndarray, near: np.ndarray) -> None:
        doubt = np.flatnonzero(near < cosine + DOUBT)
        if len(doubt):
            a, b = (_units(raw[x[doubt]].astype(np.float64)) for x in (i, j))
            real = np.ones(len(i), bool)
            real[doubt] = np.einsum("ij,ij->i", a, b) >= cosine
            i, j = i[real], j[real]
        i, j = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
        inside = [(marks[x][:, None] & _TABLE_BITS) > 0 for x in (i, j)]
        among, key = _meetings(seen[i], seen[j], *inside)
        counts = among if large else ~among & (key == lo[i])
        i, j = i[counts], j[counts]
        if len(i):
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            met, at = np.unique(np.concatenate([i, j]), return_inverse=True)
            label = joined(len(met), at[: len(i)], at[len(i) :])
            child = np.flatnonzero(label != np.arange(len(met)))
            edges.append((met[child], met[label[child]]))

    held, size = [], 0
    for found in _near(single, cosine - DOUBT, new, sides):
        held.append(found)
        size += len(found[0])
        if size >= 4096:
            whole = [np.concatenate(x) for x in zip(*held)]
            held, size = [], 0
            for k in range(0, len(whole[0]), 8192):
                count(*(x[k : k + 8192] for x in whole))
    if size:
        count(*(np.concatenate(x) for x in zip(*held)))
    label = joined(n, *(np.concatenate(x) for x in zip(*edges)))
    some, child = np.flatnonzero(links), np.flatnonzero(label != np.arange(n))
    if len(some):
        other = np.concatenate([np.full(len(some), _LOWEST), ids[label[child]]])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[some], ids[child]])), pa.array(np.concatenate([links[some], np.zeros(len(child), np.int64)])), pa.array(other, mask=np.arange(len(other)) < len(some))], ["id", "links", "other"])


def _by_key(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Rows that are in order of ``names`` in tables that split no group."""
    held: list[pa.Table] = []
    for b in batches:
        rows = pa.Table.from_batches([b])
        keys = [rows[c].to_numpy() for c in names]
        other = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
        at = int(other[-1]) + 1 if len(other) else 0
        if held and (at or any(held[-1][c][-1].as_py() != k[0] for c, k in zip(names, keys))):
            yield pa.concat_tables([*held, rows.slice(0, at)])
            held = []
        elif at:
            yield rows.slice(0, at)
        held.append(rows.slice(at))
    if held:
        yield pa.concat_tables(held)


def _bucket_links(cosine: float, kind):
    """Rows of ``_sent`` in order of part and size -> counts of links (id, links), and links that join what hangs together (id, other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        for rows in _by_key(batches, ["part", "size"]):
            keys = np.stack([rows[c].to_numpy() for c in ("part", "size")])
            new = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0)))
            for s, e in zip(new.tolist(), [*new[1:].tolist(), len(rows)]):
                head, raw, seen = (np.frombuffer(b"".join(rows[c].slice(s, e - s).to_pylist()), t) for c, t in (("head", _HEAD), ("raw", kind), ("cells", np.uint32)))
                order = np.argsort(head["key"], kind="stable")
                lo = head["key"][order]
                meet = np.zeros(len(lo), bool)
                meet[1:] = lo[1:] == lo[:-1]
                meet[:-1] |= meet[1:]
                order = order[meet]
                if len(order):
                    head, raw, seen = head[order], raw.reshape(len(meet), -1)[order], seen.reshape(len(meet), TABLES, -1)[order]
                    yield from _counted(raw, [head["key"]], [head["own"], np.ones(len(head), bool)], head["id"], head["copies"], head["large"], seen, cosine, False)

    return run


def _block_links(cosine: float, kind):
    """The same from rows (lo, hi, first, id, raw, copies, cells, large) of two home blocks each, in order of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_memory()
        for rows in _by_key(batches, ["lo", "hi"]):
            size = pc.binary_length(rows["raw"]).to_numpy()
            for dim in np.unique(size):
                of = rows.filter(pa.array(size == dim))
                lo, hi, ids, copies, marks = (of[c].to_numpy() for c in ("lo", "hi", "id", "copies", "large"))
                first, same = of["first"].to_numpy(), lo == hi
                raw = np.frombuffer(b"".join(of["raw"].to_pylist()), kind).reshape(len(of), -1)
                yield from _counted(raw, [lo, hi], [first | same, ~first | same], ids, copies, marks, _seen(of["cells"]), cosine, True)

    return run


def _home_blocks(hits: DataFrame) -> DataFrame:
    """Of classes in large buckets (id, key, own, members) the pairs of home blocks in which each is to be compared: id, lo, hi, first."""
    biggest = F.max(F.struct("members", "key"))["key"].alias("cell")
    homes = hits.groupBy("id").agg(biggest)
    parts = F.ceil(F.col("n") / F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(BLOCK), 4 * F.sqrt("n")))).cast("long")
    sizes = homes.groupBy("cell").agg(F.count("*").alias("n"))
    homes = homes.join(sizes, "cell").select("id", F.xxhash64("cell", F.pmod(F.xxhash64("id"), parts)).alias("home"))
    at = written(hits.join(homes, "id").select("id", "home", "key", "own"), "at-home")
    there = at.groupBy("key", "home").agg(F.count("*").alias("n"), F.max("own").alias("owned")).select(F.col("key").alias("k"), F.col("home").alias("with"), "n", "owned")
    meets = (F.col("key") == F.col("k")) & (F.col("own") | F.col("owned")) & ((F.col("home") != F.col("with")) | (F.col("n") > 1))
    met = at.join(there, meets).select("id", "home", "with").distinct()
    return met.select("id", F.least("home", "with").alias("lo"), F.greatest("home", "with").alias("hi"), (F.col("home") < F.col("with")).alias("first"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def linked(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    A vector that is null, empty, zero or holds a null or non-finite component
    links with nothing. Vectors of different lengths never link. Repeated rows
    are copies of one class. A null vec_id is an id below all others, and null
    in the result. Other columns are not read; an empty table gives an empty
    result.
    """
    spark = vectors.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")  # what a wave shuffled goes when it is written
    given = dict(vectors.dtypes)["embedding"]
    single = given == "array<float>"
    kind = np.float32 if single else np.float64
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(_LOWEST)).alias("vec_id"), F.col("embedding").cast(given if single else "array<double>").alias("embedding"))
    each = written(rows.transform(mapped(_classes(kind, True), "vec_id long, hash binary")), "hashes", wide=True)
    classes = rows.transform(mapped(_classes(kind, False), "vec_id long, raw binary")).where("raw IS NOT NULL").groupBy("raw").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")).select("id", "raw", "copies")
    seen = written(classes.transform(mapped(_visits(kind), "id long, raw binary, copies long, cells binary, hash binary")), "cells", wide=True)
    many, size = seen.agg(F.count("*"), F.sum(F.octet_length("raw") + F.octet_length("cells") + 60)).first()
    waves = min(MOST_WAVES, max(1, math.ceil(TABLES * (1 + PROBES) * (size or 0) / WAVE_BYTES)))
    most = max(BLOCK, min(MOST_BUCKET, int(many * BUCKET_SHARE)))
    narrow, moved = seen.select("id", "cells"), seen.select("id", "raw", "copies", "cells")
    # which buckets are large only decides how they are compared, so of many classes a sample tells them
    rate = min(1.0, max(SAMPLED, 64 * many / most) / max(1, many))
    some = narrow.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(rate * (1 << 30)))
    visits = some.transform(mapped(_listed(), "id long, key long, own boolean"))
    busy = visits.groupBy("key").agg(F.count("*").alias("members"), F.max("own").alias("any")).where((F.col("members") > most * rate) & F.col("any"))
    busy = written(busy.select("key", "members"), "busy")
    keys = np.sort(busy.select("key").toArrow()["key"].to_numpy())  # a few for each share of the classes that makes a bucket large
    found, parts = [], max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(TABLES * (1 + PROBES) * (size or 0) / waves / PART_BYTES))
    for wave in range(waves):
        sent = moved.transform(mapped(_sent(kind, keys, wave, waves, parts), "part int, size int, head binary, raw binary, cells binary"))
        dealt = sent.repartition("part").sortWithinPartitions("part", "size")
        found.append(written(dealt.transform(mapped(_bucket_links(cosine, kind), "id long, links long, other long")), "links", heavy=True))
    if len(keys):
        hits = narrow.transform(mapped(_listed(keys), "id long, key long, own boolean")).join(F.broadcast(busy), "key")
        hits = written(hits, "large")
        marked = narrowed(moved, "id", hits.select("id")).transform(mapped(_marked(keys), "id long, raw binary, copies long, cells binary, large long"))
        dealt = _home_blocks(hits).join(marked, "id").select("lo", "hi", "first", "id", "raw", "copies", "cells", "large").repartition("lo", "hi").sortWithinPartitions("lo", "hi")
        found.append(written(dealt.transform(mapped(_block_links(cosine, kind), "id long, links long, other long")), "links", heavy=True))
    found = _union(found)
    groups = components(found.where("other IS NOT NULL").select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    whole = seen.select("id", "hash", "copies").join(counts, "id", "left").join(groups, "id", "left")
    info = whole.select("hash", F.col("copies"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("component"))
    shown = lambda c: F.when(c != _LOWEST, c)
    out = each.join(info, "hash", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(shown(F.col("vec_id")).alias("vec_id"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), shown(component).alias("component_id"), (F.col("vec_id") == component).alias("kept"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS id, vec_id AS other FROM embeddings UNION SELECT r.id, l.b FROM reach r JOIN link l ON r.other = l.a),
c AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, c.component_id = e.vec_id AS kept
FROM embeddings e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
