"""Vectors of whole numbers, made from floating-point ones, and exact arithmetic on them.

A component x becomes floor(scale * x), computed in double precision; that is a
whole number whatever its size, so a double holds it exactly. Rows keep their
numbers as bytes: four each where all fit 32 bits, else eight (doubles).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Doubles hold all whole numbers up to here.
EXACT = float(1 << 53)
#: Room for the rounding of norms and bounds in double precision.
SLACK = 1 + 1e-9
LEAST, MOST = -(1 << 63) + 1, (1 << 63) - 1


def packed(column: pa.Array, scale: float, dim: int | None = None) -> tuple[pa.Array, np.ndarray]:
    """Whole numbers of each vector as bytes, and their Euclidean norms. Null (norm 0) where the vector is null, holds a null or non-finite component or one whose product with ``scale`` is beyond a double, or isn't of length ``dim``."""
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    raw, norm = [None] * len(size), np.zeros(len(size))
    for n in np.unique(size[size >= 0]).tolist() if dim is None else [dim]:
        at = np.flatnonzero(size == n)
        if not len(at):
            continue
        flat = column.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(len(at), n)
        with np.errstate(all="ignore"):
            flat = np.floor(flat * scale) + 0.0
        fine = np.isfinite(flat).all(1)
        at, flat = at[fine], flat[fine]
        norm[at] = norms(flat)
        narrow = (np.abs(flat) < 1 << 31).all(1)
        for i, v, small in zip(at.tolist(), flat, narrow.tolist()):
            raw[i] = (v.astype(np.int32) if small and n else v).tobytes()
    return pa.array(raw, pa.binary()), norm


def norms(m: np.ndarray) -> np.ndarray:
    """Euclidean norms of the rows, also where their squares are beyond a double."""
    top = np.abs(m).max(1, initial=0.0)
    safe = np.where(top > 0, top, 1.0)
    with np.errstate(over="ignore"):
        return top * np.sqrt(((m / safe[:, None]) ** 2).sum(1))


def matrices(raw: list[bytes], dims: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length among ``dims`` (of each row): the length, positions of its rows, and these rows as doubles."""
    size = np.array([len(x) for x in raw], np.int64)
    for n in np.unique(dims).tolist():
        of = np.flatnonzero(dims == n)
        out = np.zeros((len(of), n))
        for width, form in ((4, "<i4"), (8, "<f8")):
            k = np.flatnonzero(size[of] == width * n)
            if n and len(k):
                out[k] = np.frombuffer(b"".join(raw[i] for i in of[k].tolist()), form).reshape(len(k), n)
        yield n, of, out


def ints(m: np.ndarray) -> np.ndarray:
    """The same whole numbers as Python integers of any size."""
    return np.array([int(x) for x in m.ravel().tolist()], object).reshape(m.shape)


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all of ``b``; one beyond 64 bits counts as the nearest number of 64 bits."""
    largest = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * a.shape[1]
    if largest < EXACT:
        return (a @ b.T).astype(np.int64)
    return np.clip(ints(a) @ ints(b).T, LEAST, MOST).astype(np.int64)
