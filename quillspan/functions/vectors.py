"""Functions on arrays of numbers: distributions, distances, sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row. An expression used inside a lambda function would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def log_softmax(x: Column) -> Column:
    """Log probabilities of logits, in double precision. Linear in their number: the maximum and the sum are computed once."""

    def whole(v: Column) -> Column:
        total = bound(F.array_max(v), lambda m: m + F.log(F.aggregate(v, F.lit(0.0), lambda a, e: a + F.exp(e - m))))
        return bound(total, lambda z: F.transform(v, lambda e: e - z))

    return bound(x.cast("array<double>"), whole)


def argmax(x: Column) -> Column:
    """Position of the largest value from 0, the first one at ties."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("long")


def kl(log_p: Column, log_q: Column) -> Column:
    """Kullback-Leibler divergence of log probabilities, over the common length."""
    n = F.least(F.size(log_p), F.size(log_q))
    terms = F.zip_with(F.slice(log_p, F.lit(1), n), F.slice(log_q, F.lit(1), n), lambda a, b: F.exp(a) * (a - b))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def first_divergence(a: Column, b: Column) -> Column:
    """First position from 0 at which two sequences differ within their common length, else null."""
    n = F.least(F.size(a), F.size(b))
    at = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(at > 0, at - 1).cast("long")
