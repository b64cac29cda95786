"""Buckets of quantiles: never falling, and many where values crowd."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import quantiles

R = random.Random(4)
COLUMNS = {
    "times": [1.7e9 + R.randrange(100_000) for _ in range(3000)],
    "times and a zero": [0.0] + [1.7e9 + R.randrange(100_000) for _ in range(3000)],
    "tiny": [R.random() * 1e-4 for _ in range(3000)],
    "logarithms": [math.log(R.uniform(0.5, 2)) for _ in range(3000)],
    "odd": [float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 1e300, -1e300, 5e-324] + [R.gauss(0, 1) for _ in range(3000)],
}


@pytest.mark.parametrize("name", COLUMNS)
def test_buckets(spark, name):
    df = spark.createDataFrame([(x,) for x in COLUMNS[name]], "v double")
    rows = df.crossJoin(quantiles.middle(df, "v")).select("v", quantiles.bucket(F.col("v"), F.col("_low"), F.col("_high")).alias("b")).orderBy("v").collect()
    found = [r["b"] for r in rows]
    assert found == sorted(found)
    most = max(found.count(b) for b in set(found))
    assert len(set(found)) > 200 and most < len(found) // 50
    got = quantiles.quantiles(df, [], "v", {"d": ("disc", 0.9), "m": ("disc", 0.5)}).first()
    ordered = [r["v"] for r in rows]
    assert (got["d"], got["m"]) == (ordered[math.ceil(0.9 * len(ordered)) - 1], ordered[math.ceil(0.5 * len(ordered)) - 1])


def test_one_value_nulls_and_nothing(spark):
    want = {"m": ("cont", 0.5)}
    same = spark.createDataFrame([(7.0,), (7.0,), (None,)], "v double")
    assert quantiles.quantiles(same, [], "v", want).first()["m"] == 7.0
    assert quantiles.quantiles(same.where("v < 0"), [], "v", want).count() == 0
    nan = spark.createDataFrame([(float("nan"),)], "v double")
    assert math.isnan(quantiles.quantiles(nan, [], "v", {"m": ("disc", 0.5)}).first()["m"])
