"""Statistics as Column expressions: intervals, ratios, exact tests, hashes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Score interval of a share of k in n; null without trials."""
    k, n = k.cast("double"), n.cast("double")
    p = F.try_divide(k, n)
    base = 1 + F.try_divide(F.lit(z * z), n)
    mid = (p + F.try_divide(F.lit(z * z / 2), n)) / base
    half = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n)) / base
    return F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant pairs; 1 without any.

    The tail is summed from its largest term downwards, each term from the one before.
    Beyond sqrt(n (42 + ln n) / 2) + 2 steps all that remains is less than e^-42 of the
    largest term, which no double can show, so the work grows with the root of n."""
    n, low = (b + c).cast("long"), F.least(b, c).cast("long")
    up = lambda k: F.sequence(F.lit(1).cast("long"), k)
    choose = lambda k: F.aggregate(up(k), F.lit(1.0), lambda a, i: a * (n - k + i) / i)  # noqa: E731  whole numbers at every step
    exact = F.aggregate(F.sequence(F.lit(0).cast("long"), low), F.lit(0.0), lambda a, k: a + F.when(k > 0, choose(F.greatest(k, F.lit(1)))).otherwise(1.0)) / F.pow(F.lit(2.0), n)
    by_logs = F.exp(_log_binomial(n, low, up)) * _falling(n, low)
    tail = F.when(n <= 50, exact).otherwise(by_logs)  # up to 50 all sums are exact in doubles
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def _log_binomial(n: Column, k: Column, up) -> Column:
    """log(choose(n, k) / 2^n): logarithms added up for a small k, else by Stirling's series."""
    x, y = k.cast("double"), (n - k).cast("double")
    few = F.aggregate(up(F.greatest(k, F.lit(1))), F.lit(0.0), lambda a, i: a + F.log(n - k + i) - F.log(i))
    few = F.when(k > 0, few).otherwise(0.0) - n * math.log(2)
    d = (n - 2 * k) / n
    rest = lambda v: 1 / (12 * v) - 1 / (360 * v * v * v) + 1 / (1260 * v * v * v * v * v)
    many = 0.5 * (F.log(n) - math.log(2 * math.pi) - F.log(x) - F.log(y)) - x * F.log1p(-d) - y * F.log1p(d) + rest(n.cast("double")) - rest(x) - rest(y)
    return F.when(k < 32, few).otherwise(many)


def _falling(n: Column, low: Column) -> Column:
    """The sum of choose(n, k) over k <= low, in units of its last term."""
    steps = F.least(low, F.ceil(F.sqrt(n * (42 + F.log(n)) / 2)) + 2).cast("long")
    state = lambda term, total: F.struct(term.alias("term"), total.alias("total"))
    below = lambda s, i: state(s["term"] * (low - i) / (n - low + 1 + i), s["total"] + s["term"])
    return F.aggregate(F.sequence(F.lit(0).cast("long"), steps), state(F.lit(1.0), F.lit(0.0)), below, lambda s: s["total"])


def geomean(x: Column) -> Column:
    """Aggregate: exp of the mean logarithm of positive values."""
    return F.exp(F.avg(F.log(x)))


def bucket(x: Column, bounds: list[float]) -> Column:
    """Number of the first upper bound at or above x; len(bounds) beyond the last."""
    out = F.lit(len(bounds))
    for i in reversed(range(len(bounds))):
        out = F.when(x <= bounds[i], F.lit(i)).otherwise(out)
    return out


def hash_fraction(text: Column) -> Column:
    """The first 52 bits of SHA-256 as a number in [0, 1)."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 13), 16, 10).cast("bigint") / F.lit(float(16**13))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)
