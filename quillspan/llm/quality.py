"""Quality by a byte-level convolutional network, in numpy.

A text is its UTF-8 bytes in blocks of ``BLOCK``. Each byte has a learned
vector; each block also knows how many of its bytes equal the byte 2, 3, ... ``LAGS``
places before, which is how a filter can see that something repeats. Filters
span ``SPAN`` neighbouring blocks and overlap by all but one, over the whole
document; each filter's response is rectified and max-pooled over the
document, and the pooled responses combine into one probability. Max-pooling
needs no more memory for a long document than for a short one: it is taken
slice by slice, each with the blocks that a filter at its end still spans.

Fitting is bounded: ``PER_CLASS`` texts a class, of longer ones windows of ``MOST_BYTES`` code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.labels import held_out, sample
from quillspan.llm.runtime import mapped, ship, whole_rows
from quillspan.llm.words import texts

PER_CLASS, MOST_BYTES = 1500, 8192
BLOCK, SPAN, LAGS, DIM, FILTERS = 8, 3, 16, 6, 24
STEPS, RATE, BATCH = 700, 0.01, 64
CUT = 0.3
#: Bytes of text that are scored at once.
SLICE_BYTES = 1 << 18


@dataclass
class Network:
    table: np.ndarray  # 256 x DIM
    filters: np.ndarray  # SPAN x (BLOCK * DIM + LAGS - 1) x FILTERS
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # FILTERS
    shift: float


def blocks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes by block (padded with 0, at least ``SPAN`` blocks a text), equal bytes by lag, and the first block of each text."""
    size = np.diff(offsets)
    n = np.maximum(SPAN, -(-size // BLOCK))
    first = np.concatenate([[0], np.cumsum(n)])
    flat = np.zeros(first[-1] * BLOCK, np.uint8)
    at = np.repeat(first[:-1] * BLOCK - offsets[:-1], size) + np.arange(len(data))
    flat[at] = data
    equal = np.zeros((len(flat) // BLOCK, LAGS - 1), np.float32)
    begins = first[:-1, None] * BLOCK + np.arange(LAGS)
    for lag in range(2, LAGS + 1):
        same = np.zeros(len(flat), np.uint8)
        same[lag:] = (flat[lag:] == flat[:-lag]) & (flat[lag:] > 0)
        same[begins[:, :lag]] = 0  # what stands in the text before doesn't count
        equal[:, lag - 2] = np.bitwise_count(same.view(np.uint64)) if BLOCK == 8 else same.reshape(-1, BLOCK).sum(1)
    return flat.reshape(-1, BLOCK), equal / np.float32(BLOCK), first


def _inputs(net: Network, raw: np.ndarray, equal: np.ndarray) -> np.ndarray:
    x = np.empty((len(raw), BLOCK * DIM + LAGS - 1), np.float32)
    x[:, : BLOCK * DIM] = net.table[raw].reshape(len(raw), -1)
    x[:, BLOCK * DIM :] = equal
    return x


def _responses(net: Network, x: np.ndarray) -> np.ndarray:
    """Response of each filter at each block; the last ``SPAN - 1`` blocks of a text run into the next one and don't count."""
    n = len(x) - SPAN + 1
    y = x[:n] @ net.filters[0]
    for s in range(1, SPAN):
        y += x[s : s + n] @ net.filters[s]
    return y


def pooled(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    raw, equal, first = blocks(data, offsets)
    y = _responses(net, _inputs(net, raw, equal))
    for k in range(1, SPAN):
        y[first[1:-1] - k] = -np.inf
    return np.maximum(np.maximum.reduceat(y, first[:-1], axis=0) + net.bias, 0)


def pooled_long(net: Network, data: np.ndarray, size: int) -> np.ndarray:
    """As ``pooled`` of one text, in slices of ``size`` bytes (a multiple of ``BLOCK``), each read with what its lags and filters reach."""
    best, before = np.full(net.bias.shape, -np.inf, np.float32), -(-LAGS // BLOCK)
    for at in range(0, max(1, len(data)), size):
        lead = min(before, at // BLOCK)
        part = data[at - lead * BLOCK : at + size + (SPAN - 1) * BLOCK]
        if at and len(part) <= (lead + SPAN - 1) * BLOCK:
            break  # all blocks were reached from the slice before
        raw, equal, _ = blocks(part, np.array([0, len(part)]))
        raw, equal = raw[lead:], equal[lead:]
        if len(raw) >= SPAN:
            best = np.maximum(best, _responses(net, _inputs(net, raw, equal)).max(0))
    return np.maximum(best + net.bias, 0)[None]


def probabilities(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    each = pooled_long(net, data, SLICE_BYTES) if len(offsets) == 2 and len(data) > SLICE_BYTES else pooled(net, data, offsets)
    z = each.astype(np.float64) @ net.out.astype(np.float64) + net.shift
    return 1 / (1 + np.exp(-z))


def fit(rows: pa.Table, seed: int = 6) -> Network:
    """Adam on the log loss; the gradient of max-pooling reaches one block a filter and text. Without both classes the network is constant."""
    rng = np.random.Generator(np.random.PCG64(seed))
    width = BLOCK * DIM + LAGS - 1
    net = Network(rng.normal(0, 0.5, (256, DIM)).astype(np.float32), rng.normal(0, 0.15, (SPAN, width, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0)
    label = rows["label"].to_numpy()
    if len(set(label.tolist())) < 2:
        net.out[:] = 0
        net.shift = 2.0 if not len(label) or label[0] else -2.0
        return net
    parts = []
    for lo, hi, data, offsets in texts(rows["text"].combine_chunks(), 1 << 40):
        parts = [data[s:e] for s, e in zip(offsets[:-1], offsets[1:])]
    weight = np.where(label == 1, 0.5 / (label == 1).mean(), 0.5 / (label == 0).mean())
    shift = np.zeros(1, np.float32)
    params = [net.table, net.filters, net.bias, net.out, shift]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        pick = rng.choice(len(label), min(BATCH, len(label)), replace=False)
        size = np.array([len(parts[i]) for i in pick])
        raw, equal, first = blocks(np.concatenate([parts[i] for i in pick]), np.concatenate([[0], np.cumsum(size)]))
        x = _inputs(net, raw, equal)
        y = _responses(net, x)
        for k in range(1, SPAN):
            y[first[1:-1] - k] = -np.inf
        top = np.empty((len(pick), FILTERS), np.int64)
        for i, (s, e) in enumerate(zip(first[:-1], first[1:])):
            top[i] = s + y[s : min(e, len(y))].argmax(0)
        best = np.take_along_axis(y, top, 0) + net.bias
        act = np.maximum(best, 0)
        p = 1 / (1 + np.exp(-(act @ net.out + shift[0])))
        dz = ((p - label[pick]) * weight[pick] / len(pick)).astype(np.float32)
        dbest = dz[:, None] * net.out * (best > 0)
        dfilters, dtable = np.zeros_like(net.filters), np.zeros_like(net.table)
        for s in range(SPAN):
            at = top + s
            dfilters[s] = np.einsum("bf,bfw->wf", dbest, x[at])
            dx = dbest[:, :, None] * net.filters[s].T[None, :, : BLOCK * DIM]
            np.add.at(dtable, raw[at].reshape(-1), dx.reshape(-1, DIM))
        grads = [dtable, dfilters + 1e-4 * net.filters, dbest.sum(0), act.T @ dz + 1e-4 * net.out, np.array([dz.sum()], np.float32)]
        rate = RATE * min(1, 2 * (1 - step / (STEPS + 1)))
        for q, g, a, b in zip(params, grads, m, v):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    net.shift = float(shift[0])
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Network:
    return fit(sample(docs, labels, label, PER_CLASS, MOST_BYTES))


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null texts count as empty, an empty text is scored by its padding; texts
    of any length are read whole; repeated rows have equal scores; a null doc_id
    stays null and counts as the empty text in ``held_out``; only doc_id and
    text are read, whatever other columns are called; an empty table gives an
    empty result.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in texts(b.column(2), SLICE_BYTES):
                p = probabilities(shared.value, data, offsets)
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(1)[lo:hi], pa.array(p), pa.array((p >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.transform(mapped(run, "doc_id long, held_out boolean, score double, predicted int"))


def accepted(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` without those that the network rejects, all columns as they are, whatever they are called: the score is computed beside each row, with or without a doc_id. Null and empty texts are scored like any other, repeated rows go the same way, an empty table stays empty."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in texts(b.column(1), SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).filter(pa.array(probabilities(shared.value, data, offsets) >= CUT))], ["row"])

    return whole_rows(docs, run)
