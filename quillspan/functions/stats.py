"""Statistics as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null (the place of NaN for an empty group)."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def share(condition: Column) -> Column:
    """Share of rows for which a condition holds; null counts as no."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


#: What Stirling's formula lacks of the logarithm of x!, for x from 0 to 15 (at 0 it isn't used).
_STIRLING_ERRORS = [0.0, *(math.lgamma(x + 1) - ((x + 0.5) * math.log(x) - x + math.log(2 * math.pi) / 2) for x in range(1, 16))]
#: Steps of the continued fraction: so many and the root of the count.
FRACTION_STEPS = 30


def _stirling_error(x: Column) -> Column:
    series = (1 / 12 - (1 / 360 - (1 / 1260 - F.lit(1 / 1680) / (x * x)) / (x * x)) / (x * x)) / x
    return F.when(x < 16, F.get(F.array(*map(F.lit, _STIRLING_ERRORS)), x.cast("int"))).otherwise(series)


def _half_tail(n: Column, k: Column) -> Column:
    """P(X <= k) of n fair coins for k < n / 2 (doubles).

    This is the incomplete beta function at 1/2 with a = n - k and b = k + 1: the
    probability of k times a continued fraction, which needs steps in proportion
    to the root of n. The probability comes from Stirling's formula with what
    that lacks, so nothing cancels that is large.
    """
    u = (2 * k - n) / n
    distance = n / 2 * ((1 + u) * F.log1p(u) + (1 - u) * F.log1p(-u))
    point = F.when(k == 0, F.exp(-n * math.log(2))).otherwise(F.sqrt(n / (2 * math.pi * k * (n - k))) * F.exp(_stirling_error(n) - _stirling_error(k) - _stirling_error(n - k) - distance))
    s = F.struct((n - k).alias("a"), (k + 1).alias("b"), point.alias("point"), F.sequence(F.lit(1), (F.lit(FRACTION_STEPS) + F.floor(F.sqrt(n))).cast("int")).alias("steps"))

    def fraction(v: Column) -> Column:
        a, b = v["a"], v["b"]

        def step(t: Column, i: Column) -> Column:
            m = i.cast("double")
            even, odd = m * (b - m) / (2 * (a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) / (2 * (a + 2 * m) * (a + 2 * m + 1))
            return _bound(F.struct((1 / (1 + even * t["d"])).alias("d"), (1 + even / t["c"]).alias("c"), odd.alias("odd"), t["h"].alias("h")), lambda e: _bound(F.struct((1 / (1 + e["odd"] * e["d"])).alias("d"), (1 + e["odd"] / e["c"]).alias("c"), (e["h"] * e["d"] * e["c"]).alias("h")), lambda o: F.struct(o["d"].alias("d"), o["c"].alias("c"), (o["h"] * o["d"] * o["c"]).alias("h"))))

        first = 1 / (1 - (a + b) / (2 * (a + 1)))
        return v["point"] / 2 * F.aggregate(v["steps"], F.struct(first.alias("d"), F.lit(1.0).alias("c"), first.alias("h")), step, lambda t: t["h"])

    return _bound(s, fraction)


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mcnemar(b: Column, c: Column) -> Column:
    """Two-sided exact McNemar test of discordant counts; 1 where they differ by at most one (half of the coins' outcomes), a power of two where one is 0, null where one is null. Time and memory grow with the root of the counts."""
    n, k = (b + c).cast("double"), F.least(b, c).cast("double")
    return F.when(n.isNull(), None).when(F.abs(b - c) <= 1, 1.0).when(k == 0, F.pow(F.lit(2.0), 1 - n)).otherwise(F.least(F.lit(1.0), 2 * _half_tail(n, k)))


def change_percent(a: Column, b: Column) -> Column:
    """Signed change from b to a as text with two places, such as +3.10%; null where b is 0."""
    r = ratio(a, b)
    return F.when(r.isNotNull(), F.format_string("%+.2f%%", (r - 1) * 100))
