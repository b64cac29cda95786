"""Paired experiments: blocks with a baseline and an arm side, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .quantiles import quantiles


def paired(base: DataFrame, arm: DataFrame, key: str) -> DataFrame:
    """Full outer join of two sides by block: columns of the sides as base_* and arm_*,
    and `state`: paired, base_only or arm_only. Keys are unique on either side."""
    a = base.select(F.col(key), F.lit(True).alias("_a"), *[F.col(c).alias(f"base_{c}") for c in base.columns if c != key])
    b = arm.select(F.col(key), F.lit(True).alias("_b"), *[F.col(c).alias(f"arm_{c}") for c in arm.columns if c != key])
    state = F.when(F.col("_a") & F.col("_b"), "paired").when(F.col("_a"), "base_only").otherwise("arm_only")
    return a.join(b, key, "full").withColumn("state", state).drop("_a", "_b")


def paired_statistics(pairs: DataFrame, passed: str, cost: str, digits: int = 6) -> DataFrame:
    """One row over complete pairs (base_/arm_ of a pass flag and of a cost)."""
    bp, ap, bc, ac = F.col(f"base_{passed}"), F.col(f"arm_{passed}"), F.col(f"base_{cost}"), F.col(f"arm_{cost}")
    n = F.count("*")
    only_b, only_a = F.count_if(bp & ~ap), F.count_if(ap & ~bp)
    both = bp & ap
    log_ratio = F.when(both, F.log(ac / bc))
    whole = pairs.where("state = 'paired'")
    middle = quantiles(whole.select(log_ratio.alias("l")), [], "l", {"median_log_ratio": ("cont", 0.5)})
    p = whole.agg(
        n.alias("n"), F.count_if(bp).alias("base_passed"), F.count_if(ap).alias("arm_passed"), only_b.alias("base_only"), only_a.alias("arm_only"), F.count_if(both).alias("n_both"),
        F.sum(bc).alias("base_total"), F.sum(ac).alias("arm_total"), F.avg(log_ratio).alias("log_ratio"),
    )
    p = p.join(middle, F.lit(True), "left")  # one row on either side
    low, high = stats.wilson(F.col("arm_passed"), F.col("n"))
    r = lambda c: F.round(c, digits)
    return p.select(
        "n", "base_passed", "arm_passed", "base_only", "arm_only", "n_both", r(F.col("base_total")).alias("base_total"), r(F.col("arm_total")).alias("arm_total"),
        r(stats.ratio(F.col("arm_total"), F.col("base_total"))).alias("total_ratio"), r(F.exp("log_ratio")).alias("geo_ratio"), r(F.exp("median_log_ratio")).alias("median_ratio"),
        r(low).alias("arm_low"), r(high).alias("arm_high"), r(stats.mcnemar(F.col("base_only"), F.col("arm_only"))).alias("p"), r(stats.ratio(F.col("arm_passed") - F.col("base_passed"), F.col("n"))).alias("pass_difference"),
    )


#: Which pairs a group of measures is about.
GROUPS = ("all", "baseline_passed", "both_passed")


def measures_of(passed: str, times: dict[str, str]) -> dict[str, Column]:
    """The measures of one pair by name: who passed, and per group of pairs and per time (a
    name to the column's name behind base_ and arm_) how many pairs have it, both sides, and
    the logarithm of arm over base.

    Outside its group a pair counts 0 and has no logarithm; neither has a pair with a time
    that is missing or not above zero, which `<time>_unusable` counts when it is there.
    """
    b, a = F.col(f"base_{passed}"), F.col(f"arm_{passed}")
    within = dict(zip(GROUPS, (F.lit(True), b, b & a), strict=True))
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    out = {"pairs": F.lit(1), "base_passes": one(b), "arm_passes": one(a), "only_base_passes": one(b & ~a), "only_arm_passes": one(a & ~b), "both_pass": one(b & a)}
    for time, column in times.items():
        x, y = F.col(f"base_{column}"), F.col(f"arm_{column}")
        there = x.isNotNull() & y.isNotNull()
        usable = there & (x > 0) & (y > 0)
        for group, holds in within.items():
            out[f"{group}_{time}_n"] = one(holds & there)
            out[f"{group}_{time}_base"] = F.when(holds & there, x).otherwise(0.0)
            out[f"{group}_{time}_arm"] = F.when(holds & there, y).otherwise(0.0)
            out[f"{group}_{time}_log"] = F.when(holds & usable, F.log(y / x))
        out[f"{time}_unusable"] = one(there & ~usable)
    return out


def pair_measures(pairs: DataFrame, passed: str, times: dict[str, str]) -> DataFrame:
    """pairs with the columns of measures_of(); a column of pairs with such a name is replaced."""
    made = measures_of(passed, times)
    return pairs.select(*[c for c in pairs.columns if c not in made], *[c.alias(n) for n, c in made.items()])


def summed_measures(measured: DataFrame, by: list[str], passed: str, times: dict[str, str]) -> DataFrame:
    """Measures of pairs added up by groups: counts and times as sums, logarithms as lists
    (sorted), and all base and arm times as lists (`<time>_base_list`, `<time>_arm_list`)."""
    made = measures_of(passed, times)
    sums = [F.sort_array(F.collect_list(n)).alias(n) if n.endswith("_log") else F.sum(n).alias(n) for n in made]
    lists = [F.sort_array(F.collect_list(f"{side}_{c}")).alias(f"{time}_{side}_list") for time, c in times.items() for side in ("base", "arm")]
    return measured.groupBy(*by).agg(*sums, *lists)


def draw(replicate: Column, slot: Column, n: Column, seed: int) -> Column:
    """A cluster number below n, drawn by SHA-256 of (seed, replicate, slot)."""
    text = F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), slot.cast("string"))
    return F.pmod(F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 13), 16, 10).cast("bigint"), n)


def cluster_bootstrap(rows: DataFrame, cluster: str, numerator: str, denominator: str, replicates: int = 4_000, seed: int = 1) -> DataFrame:
    """95 % interval of a ratio of sums, clusters drawn with replacement.

    Rows are summed per cluster first, so only replicates x clusters small rows are
    shuffled. Without a defined ratio in any replicate there is no interval.
    """
    sums = rows.groupBy(cluster).agg(F.sum(numerator).alias("a"), F.sum(denominator).alias("b"))
    packed = sums.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col(cluster).alias("c"), "a", "b"))).alias("s"))  # one row per cluster: bounded by the design
    one = packed.withColumn("n", F.size("s"))
    drawn = one.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    picks = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("s", draw(F.col("rep"), i, F.col("n").cast("long"), seed).cast("int")))
    total = lambda field: F.aggregate("picks", F.lit(0.0), lambda x, s: x + s[field].cast("double"))
    ratios = drawn.withColumn("picks", picks).select(stats.ratio(total("a"), total("b")).alias("r"))
    bad = F.count_if(F.col("r").isNull()) > 0
    return ratios.agg(F.when(~bad, F.percentile("r", F.lit(0.025))).alias("low"), F.when(~bad, F.percentile("r", F.lit(0.975))).alias("high"), F.count("*").alias("replicates"))
