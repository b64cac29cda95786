"""The exact test of McNemar over few and over many discordant pairs."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import stats


def whole(b, c):
    n = b + c
    return min(1.0, float(Fraction(2 * sum(math.comb(n, k) for k in range(min(b, c) + 1)), 2**n)))


def by_lgamma(b, c):
    n, low = b + c, min(b, c)
    terms = (math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2)) for k in range(low, -1, -1))
    return min(1.0, 2 * math.fsum(terms))


def got(spark, pairs):
    rows = spark.createDataFrame([(i, b, c) for i, (b, c) in enumerate(pairs)], "i long, b long, c long")
    return [r["p"] for r in rows.select("i", stats.mcnemar(F.col("b"), F.col("c")).alias("p")).orderBy("i").collect()]


def test_p_is_exact_for_every_kind_of_split(spark):
    pairs = [(0, 0), (0, 1), (3, 9), (25, 25), (25, 26), (0, 51), (1, 70), (31, 40), (32, 40), (32, 900), (300, 360), (500, 500), (700, 800)]
    for p, (b, c) in zip(got(spark, pairs), pairs, strict=True):
        assert p == pytest.approx(whole(b, c), rel=1e-11), (b, c)


def test_hundreds_of_thousands_and_billions_of_pairs(spark):
    pairs = [(200_000, 201_000), (201_500, 200_000), (2_000_000_000, 2_000_000_000), (2_000_000_000, 2_000_100_000)]
    p = got(spark, pairs)  # a sum of sums of logarithms never came to an end, and whole numbers overflowed
    assert p[:2] == pytest.approx([by_lgamma(*x) for x in pairs[:2]], rel=1e-6) and p[2] == 1.0
    # by the normal curve with half a step of correction
    assert p[3] == pytest.approx(math.erfc((100_000 - 1) / math.sqrt(4_000_100_000) / math.sqrt(2)), rel=1e-4)
