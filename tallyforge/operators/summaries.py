"""Aggregates whose keys, sums and statistics are functions that the caller passes in:
each takes a frame and returns a Column of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Of = Callable[[DataFrame], Column]


def summarised(df: DataFrame, key: Of, measures: dict[str, Of]) -> DataFrame:
    """A row per value of `key` with the named measures."""
    return df.groupBy(key(df).alias("key")).agg(*[m(df).alias(name) for name, m in measures.items()])


def over_clusters(df: DataFrame, cluster: Of, sums: dict[str, Of], statistics: dict[str, Of]) -> DataFrame:
    """One row of statistics over the sums of each cluster."""
    totals = df.groupBy(cluster(df).alias("cluster")).agg(*[s(df).alias(name) for name, s in sums.items()])
    return totals.agg(*[s(totals).alias(name) for name, s in statistics.items()])


def metrics(df: DataFrame, selectors: dict[str, Of]) -> DataFrame:
    """(metric, mean, n) of each selector over the rows where it is not null, in one pass."""
    one = df.agg(*[F.struct(F.lit(name).alias("metric"), F.avg(s(df)).alias("mean"), F.count(s(df)).alias("n")).alias(f"m{i}") for i, (name, s) in enumerate(selectors.items())])
    return one.select(F.inline(F.array(*one.columns)))


def cascade(df: DataFrame, judges: dict[str, Of], otherwise: str) -> Column:
    """The first name, in order, whose judge holds."""
    out = None
    for name, judge in judges.items():
        out = F.when(judge(df), name) if out is None else out.when(judge(df), name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)
