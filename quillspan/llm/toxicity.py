"""Toxicity by a chain of linear classifiers.

Categories come in a fixed order. Each has a logistic model over the presence
of words and over the probabilities of all categories before it. While
fitting, those probabilities are out-of-fold predictions, so that a later
model sees earlier ones as they are on texts they haven't learned from;
applying the chain feeds each model's own predictions forward.

Where a table marks toxic texts only, the first categories are kinds of toxic
texts found by clustering the marked ones on the words that go with the mark;
the last category is the mark itself. A text's kinds are thus learned before the
chain decides whether it is toxic.

Words are runs of letters (ASCII lower case; all bytes outside ASCII count as
letters). A text has its words and, since a stem takes many endings, the first
bytes of longer ones (``STEMS``). Only those whose presence differs clearly
between classes become features, ``MOST_FEATURES`` at most. Fitting is bounded: ``PER_CLASS`` texts a
class, of longer ones windows of ``MOST_BYTES`` code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.labels import FOLDS, held_out, sample
from quillspan.llm.runtime import mapped, mix64, ship
from quillspan.llm.words import byte_hashes, split_words, texts

PER_CLASS, MOST_BYTES = 3000, 8192
LEAST_TEXTS, LEAST_Z, MOST_FEATURES, RIDGE, CUT = 5, 5.0, 256, 1.0, 0.5
KINDS, ROUNDS = 2, 12
#: Lengths of stems in bytes.
STEMS = (4, 5, 6, 7)
CATEGORIES = (*(f"kind_{k + 1}" for k in range(KINDS)), "toxic")
_BETWEEN = np.ones(256, bool)
_BETWEEN[65:91] = _BETWEEN[97:123] = _BETWEEN[128:] = False


@dataclass
class Chain:
    categories: tuple[str, ...]
    words: np.ndarray  # sorted hashes of the feature words
    weights: list[np.ndarray]  # per category: features, earlier probabilities, bias


def present(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words and stems of the texts as (text, hash), repeated ones too."""
    w = split_words(data, offsets, lower=True, between=_BETWEEN)
    text, size = w.text_of(), w.end - w.start
    found, of = [w.hash], [text]
    for k in STEMS:
        long = np.flatnonzero(size > k)
        found.append(byte_hashes(w.data, w.start[long], w.start[long] + k, 0x3C6EF372FE94F82B))
        of.append(text[long])
    return np.concatenate(of), np.concatenate(found)


def features(words: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    text, h = present(data, offsets)
    x = np.zeros((len(offsets) - 1, len(words)), np.float32)
    if len(words):
        at = np.minimum(np.searchsorted(words, h), len(words) - 1)
        hit = words[at] == h
        x[text[hit], at[hit]] = 1
    return x


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the bias, which the ridge spares."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    ridge[-1] = 1e-3
    for _ in range(12):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-5:
            break
    return w


def apply(chain: Chain, x: np.ndarray) -> np.ndarray:
    """Probability of each category, in order, a column each."""
    out = np.zeros((len(x), len(chain.weights)))
    for i, w in enumerate(chain.weights):
        out[:, i] = _sigmoid(np.hstack([x, out[:, :i], np.ones((len(x), 1))]) @ w)
    return out


def kinds(x: np.ndarray, k: int = KINDS, rounds: int = 20) -> np.ndarray:
    """Cluster of each row of 0 and 1: spherical k-means, begun from the row with most ones and then from rows farthest from those before, so alike in every run. A row without ones is of kind 0."""
    size = np.sqrt(x.sum(1))
    unit = x / np.maximum(size, 1)[:, None]
    if not len(x):
        return np.zeros(0, np.int64)
    centres = [unit[size.argmax()]]
    for _ in range(k - 1):
        near = np.max([unit @ c for c in centres], axis=0)
        centres.append(unit[np.where(size > 0, near, 2.0).argmin()])
    of = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        new = np.where(size > 0, (unit @ np.array(centres).T).argmax(1), 0)
        if (new == of).all():
            break
        of = new
        centres = [m / max(np.linalg.norm(m), 1e-12) if (m := unit[of == c].sum(0)).any() else centres[c] for c in range(k)]
    return of


def telling_words(labels: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray, slice_bytes: int = 1 << 20) -> np.ndarray:
    """Hashes, in order, of words and stems whose presence differs clearly between the classes of some category. Texts are taken slice by slice, and what few of them have is dropped before it is weighed. Of those that the same texts have, one stays. Words are picked in rounds; texts that have a picked word count less from then on, so that rarer kinds get theirs."""
    n, lo, seen, text = len(offsets) - 1, 0, [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + slice_bytes, "right")) - 1)
        of, found = present(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        order = np.lexsort((found, of))
        of, found = of[order], found[order]
        new = np.append(True, (of[1:] != of[:-1]) | (found[1:] != found[:-1]))[: len(of)]
        seen.append(found[new])
        text.append((lo + of[new]).astype(np.int32))
        lo = hi
    every, of = np.concatenate(seen), np.concatenate(text)
    order = np.argsort(every)
    every, of = every[order], of[order]
    first = np.flatnonzero(np.append(True, every[1:] != every[:-1])[: len(every)])
    count = np.diff(np.append(first, len(every)))
    often = np.repeat(count >= LEAST_TEXTS, count)
    every, of = every[often], of[often]
    words, count = every[np.append(True, every[1:] != every[:-1])[: len(every)]], count[count >= LEAST_TEXTS]
    at = np.repeat(np.arange(len(words)), count)
    first = np.cumsum(count) - count
    alike = np.add.reduceat(mix64(of.astype(np.uint64)), first) if len(of) else np.zeros(0, np.uint64)
    alone = np.unique(alike, return_index=True)[1]
    free = np.zeros(len(words), bool)
    free[alone] = True
    for y in labels.values():
        weight = np.ones(n)
        for _ in range(ROUNDS):
            ones, both = np.bincount(at, (weight * y)[of], len(words)), np.bincount(at, weight[of], len(words))
            share = (weight * y).sum() / max(weight.sum(), 1e-9)
            z = np.where(free, (ones - both * share) / np.sqrt(np.maximum(both * share * (1 - share), 1e-9)), 0)
            best = np.argsort(-z, kind="stable")[: max(1, MOST_FEATURES // (ROUNDS * len(labels)))]
            best = best[z[best] >= LEAST_Z]
            if not len(best):
                break
            free[best] = False
            told = np.zeros(len(words), bool)
            told[best] = True
            covered = np.zeros(n, bool)
            covered[of[told[at]]] = True
            weight[covered & (y == 1)] *= 0.3
    return np.sort(words[alone[~free[alone]]])


def kind_labels(toxic: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Labels of the kinds of marked texts and, last, of the mark itself."""
    toxic = toxic.astype(float)
    x, of = features(telling_words({"toxic": toxic}, data, offsets), data, offsets), np.full(len(toxic), -1)
    of[toxic == 1] = kinds(x[toxic == 1])
    return {name: (of == k).astype(float) for k, name in enumerate(CATEGORIES[:-1])} | {CATEGORIES[-1]: toxic}


def out_of_fold(x: np.ndarray, y: np.ndarray, fold: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Probability of each row by a model that was fitted without its fold; by the ``whole`` model where the other folds have one class only."""
    out = np.zeros(len(y))
    for f in np.unique(fold):
        own = fold == f
        w = logistic(x[~own], y[~own]) if len(set(y[~own].tolist())) > 1 else whole
        out[own] = _sigmoid(np.hstack([x[own], np.ones((own.sum(), 1))]) @ w)
    return out


def fit(labels: dict[str, np.ndarray], data: np.ndarray, offsets: np.ndarray, fold: np.ndarray) -> Chain:
    """A chain over ``labels`` in their order; ``fold`` numbers the fold of each text. A category of one class has a constant model."""
    n = len(offsets) - 1
    chain = Chain(tuple(labels), telling_words(labels, data, offsets), [])
    x = features(chain.words, data, offsets)
    before = np.zeros((n, 0))
    for y in labels.values():
        own = np.hstack([x, before])
        if len(set(y.tolist())) < 2:
            w = np.zeros(own.shape[1] + 1)
            w[-1] = 5.0 if n and y[0] else -5.0
            unseen = np.full(n, _sigmoid(w[-1:])[0])
        else:
            w = logistic(own, y)
            unseen = out_of_fold(own, y, fold, w)
        chain.weights.append(w)
        before = np.hstack([before, unseen[:, None]])
    return chain


def folds(n: int) -> np.ndarray:
    return (mix64(np.arange(n, dtype=np.uint64)) % np.uint64(FOLDS)).astype(np.int64)


def fit_table(rows: pa.Table) -> Chain:
    """A chain from sampled rows (text, label)."""
    column = rows["text"].combine_chunks()
    got = list(texts(column, 1 << 40)) if len(column) else [(0, 0, np.zeros(0, np.uint8), np.zeros(1, np.int64))]
    _, _, data, offsets = got[0]
    return fit(kind_labels(rows["label"].to_numpy(), data, offsets), data, offsets, folds(len(column)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Chain:
    return fit_table(sample(docs, labels, label, PER_CLASS, MOST_BYTES))


def scored(docs: DataFrame, chain: Chain) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, a probability p_<category> for each category, predicted (1 if the last is at least ``CUT``).

    Null and empty texts have no words and get the chain's base rates; texts
    of any length are read whole; repeated rows have equal results; a null doc_id
    stays null and counts as the empty text in ``held_out``; only doc_id and
    text are read, whatever other columns are called; an empty table gives an
    empty result.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = ["doc_id", "held_out", *(f"p_{c}" for c in chain.categories), "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in texts(b.column(2)):
                p = apply(shared.value, features(shared.value.words, data, offsets))
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(1)[lo:hi], *(pa.array(c) for c in p.T.copy()), pa.array((p[:, -1] >= CUT).astype(np.int32))], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.transform(mapped(run, "doc_id long, held_out boolean, " + ", ".join(f"p_{c} double" for c in chain.categories) + ", predicted int"))
