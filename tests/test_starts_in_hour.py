"""Starts in the last hour: ties, rows exactly an hour apart, no time, and crowded hours."""

import datetime
import random
import time

from pyspark.sql import functions as F

from tallyforge.streaming import feeds

DAY = datetime.datetime(2024, 1, 1)


def test_counts_are_those_of_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, None if i % 40 == 0 else DAY + datetime.timedelta(seconds=rng.choice([600 * rng.randrange(30), rng.random() * 18_000]))) for i in range(400)]
    hour = datetime.timedelta(hours=1)
    want = {i: sum(1 for _, u in rows if (u is None if t is None else u is not None and t - hour <= u <= t)) for i, t in rows}
    got = feeds.starts_in_last_hour(spark.createDataFrame(rows, "id long, ts timestamp_ntz"), "ts")
    assert got.columns == ["id", "ts", "in_hour"] and {r["id"]: r["in_hour"] for r in got.collect()} == want


def test_a_crowded_hour_takes_no_time_per_pair(spark):
    n = 400_000  # two hours of 200,000 rows each: 4e10 pairs
    rows = spark.range(n).select("id", (F.lit(1_704_067_200) + F.col("id") * (7200 / n)).cast("timestamp").alias("ts"))
    began = time.monotonic()
    got = feeds.starts_in_last_hour(rows, "ts").agg(F.sum("in_hour").alias("s"), F.max("in_hour").alias("m")).first()
    assert time.monotonic() - began < 60
    half = n // 2
    assert got["m"] == half + 1 and got["s"] == half * (half + 1) // 2 + (n - half) * (half + 1)
