"""Exact quantiles per group that sort no whole column in one task.

Values fall into buckets by a monotone function of the value: one part follows the
logarithm, from 2^-40 up, the other divides the middle of the column evenly, so that
neither tiny values nor times far from zero share one bucket. A first pass counts rows
per group and bucket; from these small counts follows which bucket holds each wanted
position. A second pass counts the values of those buckets only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets per doubling of the value, and even ones between the column's SPREAD.
FINE, EVEN = 256, 8192
#: Approximate shares of the column between which the even buckets lie.
SPREAD = (0.005, 0.995)


def middle(df: DataFrame, value: str) -> DataFrame:
    """One row: low and high, about the SPREAD of the finite values; null without any.
    They only place buckets, so their error moves no result."""
    x = F.col(value).cast("double")
    ends = F.percentile_approx(F.when(F.abs(x) < float("inf"), x), list(SPREAD), 1000)
    return df.agg(ends.alias("_ends")).select(F.col("_ends")[0].alias("_low"), F.col("_ends")[1].alias("_high"))


def bucket(v: Column, low: Column, high: Column) -> Column:
    """A whole number that never falls as v grows, as the sum of two such numbers; NaN
    comes last, as in sorting."""
    x = v.cast("double")
    step = F.least(F.floor(F.log2(1 + F.abs(x) * float(1 << 40)) * FINE), F.lit(1 << 39)) * F.signum(x)
    inside = F.least(F.greatest(x, low), high)
    even = F.when(high > low, F.floor((inside - low) / (high - low) * EVEN)).otherwise(0)
    return F.when(F.isnan(x), F.lit(1 << 40)).otherwise(step + F.coalesce(even, F.lit(0))).cast("long")


def positions(kind: str, q: float, n: Column) -> tuple[Column, Column, Column]:
    """Places (from 0) of the two values between which a quantile lies, and how far.

    cont: (n - 1) q, interpolated; disc: nearest rank; floor: element floor(q n), clamped.
    """
    if kind == "cont":
        at = (n - 1) * F.lit(q)
        return F.floor(at), F.ceil(at), at - F.floor(at)
    if kind == "disc":
        k = F.greatest(F.ceil(F.lit(q) * n) - 1, F.lit(0))
    elif kind == "floor":
        k = F.least(n - 1, F.floor(F.lit(q) * n))
    else:
        raise ValueError(f"no quantile {kind}")
    return k, k, F.lit(0.0)


def quantiles(df: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """by and a column per wanted name -> (kind, q); rows with a null value are left out,
    and groups without a value have no row. disc and floor keep the value's type."""
    kind = dict(df.dtypes)[value]
    rows = df.where(F.col(value).isNotNull()).select(F.struct(F.lit(0).alias("_"), *by).alias("k"), F.col(value).alias("v"))
    ranged = rows.crossJoin(F.broadcast(middle(df, value)))  # one row
    rows = ranged.select("k", "v", bucket(F.col("v"), F.col("_low"), F.col("_high")).alias("b"))
    hist = rows.groupBy("k", "b").agg(F.count("*").alias("n"))
    group = Window.partitionBy("k")
    hist = hist.select("k", "b", "n", (F.sum("n").over(group.orderBy("b")) - F.col("n")).alias("before"), F.sum("n").over(group).alias("total"))
    ends = [(i, side, p) for i, (how, q) in enumerate(wanted.values()) for side, p in enumerate(positions(how, q, F.col("total"))[:2])]
    asked = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), p.cast("long").alias("p")) for i, side, p in ends])
    asked = F.filter(asked, lambda a: (a["p"] >= F.col("before")) & (a["p"] < F.col("before") + F.col("n")))
    spots = hist.select("k", "b", "before", "total", F.explode(asked).alias("a"))  # two rows per group and name
    values = rows.join(spots.select("k", "b").distinct(), ["k", "b"]).groupBy("k", "b", "v").agg(F.count("*").alias("n"))
    placed = values.select("k", "b", "v", "n", (F.sum("n").over(Window.partitionBy("k", "b").orderBy("v")) - F.col("n")).alias("inside"))
    at = F.col("a")["p"] - F.col("before")
    hits = placed.join(spots, ["k", "b"]).where((at >= F.col("inside")) & (at < F.col("inside") + F.col("n")))
    pick = lambda i, side: F.max(F.when((F.col("a")["i"] == i) & (F.col("a")["side"] == side), F.col("v")))
    out = hits.groupBy("k").agg(F.max("total").alias("total"), *[pick(i, s).alias(f"x{i}_{s}") for i, s, _ in ends])
    columns = []
    for i, (name, (how, q)) in enumerate(wanted.items()):
        low, high, share = F.col(f"x{i}_0"), F.col(f"x{i}_1"), positions(how, q, F.col("total"))[2]
        between = low.cast("double") + (high.cast("double") - low.cast("double")) * share
        columns.append((between if how == "cont" else low.cast(kind)).alias(name))
    return out.select(*[F.col("k")[c].alias(c) for c in by], *columns)


def with_quantiles(grouped: DataFrame, df: DataFrame, by: list[str], value: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """grouped (a row per group of df) with the quantiles as further columns; null where
    a group has no value."""
    q = quantiles(df, by, value, wanted)
    if not by:
        return grouped.join(q, how="left", on=F.lit(True))  # one row on either side
    q = q.select(F.struct(*by).alias("_by"), *wanted)
    return grouped.join(q, F.struct(*[grouped[c] for c in by]) == q["_by"], "left").drop("_by")
