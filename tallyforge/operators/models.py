"""Folds, scores and small models as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from .quantiles import quantiles


def folds(df: DataFrame, key: str, k: int, holdout: float, seed: str) -> DataFrame:
    """df with `fold`: -1 for held-out keys, else 0 to k - 1, by hash of the key."""
    u = stats.hash_fraction(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.withColumn("fold", F.when(u < holdout, -1).otherwise(F.least(F.floor((u - holdout) / (1 - holdout) * k), F.lit(k - 1))).cast("int"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row `auc` from score-value counts, ties counted half; null without both classes.

    Positives and negatives are counted per score value, the values are cut into
    ranges, and only a row per range is summed in one place.
    """
    counts = df.where(f"{score} is not null and {label} is not null").groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("double")).alias("p"), F.sum(1.0 - F.col(label)).alias("n"))
    ranged = counts.repartitionByRange("s").withColumn("part", F.spark_partition_id())
    w = Window.partitionBy("part").orderBy("s")
    own = ranged.withColumn("below", F.sum("n").over(w) - F.col("n"))
    parts = own.groupBy("part").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("wins"))
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")  # a row per range
    total = parts.withColumn("wins", F.col("wins") + F.col("p") * before).agg(F.sum("wins").alias("w"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return total.select(F.try_divide(F.col("w"), F.col("p") * F.col("n")).alias("auc"))


def log_loss(p: Column, y: Column, clip: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))


def cell_table(df: DataFrame, prior_key: list[str], cell_key: list[str], label: str, pseudo: float = 5.0) -> DataFrame:
    """Smoothed rate per cell: pseudo rows at the rate of the cell's prior group."""
    prior = df.groupBy(*prior_key).agg(F.avg(label).alias("prior"))
    cells = df.groupBy(*cell_key).agg(F.sum(label).alias("k"), F.count("*").alias("n"))
    return cells.join(prior, prior_key).withColumn("rate", (F.col("k") + pseudo * F.col("prior")) / (F.col("n") + pseudo))


def logistic(df: DataFrame, features: list[str], label: str, l2: float = 1.0, rounds: int = 8) -> list[float]:
    """Weights (intercept first) of a logistic model, L2 on the summed loss, intercept
    free, by Newton steps: each step is one aggregate of (k + 1)^2 sums."""
    import numpy as np

    k = len(features) + 1
    w = np.zeros(k)
    x = [F.lit(1.0), *[F.col(f).cast("double") for f in features]]
    rows = df.select(*[c.alias(f"x{i}") for i, c in enumerate(x)], F.col(label).cast("double").alias("y")).persist()
    for _ in range(rounds):
        z = sum((F.col(f"x{i}") * float(w[i]) for i in range(1, k)), F.lit(float(w[0])))
        p = 1 / (1 + F.exp(-z))
        g = [F.sum((F.col("y") - F.col("p")) * F.col(f"x{i}")) for i in range(k)]
        h = [F.sum(F.col("p") * (1 - F.col("p")) * F.col(f"x{i}") * F.col(f"x{j}")) for i in range(k) for j in range(i + 1)]
        r = rows.withColumn("p", p).agg(*g, *h).collect()[0]
        grad, hess, at = np.array(r[:k]), np.zeros((k, k)), k
        for i in range(k):
            for j in range(i + 1):
                hess[i, j] = hess[j, i] = r[at]
                at += 1
        ridge = np.diag([0.0] + [l2] * (k - 1))
        step = np.linalg.solve(hess + ridge, grad - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    rows.unpersist()
    return w.tolist()


def gini_stump_tree(df: DataFrame, features: list[str], label: str, depth: int = 2, cuts: int = 19, leaf: int = 30) -> DataFrame:
    """Leaves of a Gini tree over quantile cuts: (leaf, n, rate), rates Laplace-smoothed.

    Each level is one aggregate over all candidate cuts of all open nodes.
    """
    shares = {f"q{i}": ("cont", (i + 1) / (cuts + 1)) for i in range(cuts)}
    q = {f: [x for r in quantiles(df, [], f, shares).collect() for x in r] for f in features}  # one row each
    rows = df.withColumn("leaf", F.lit("")).withColumn("y", F.col(label).cast("double"))
    for _ in range(depth):
        tests = [(f, float(c)) for f in features for c in sorted(set(q[f]))]
        exprs = [F.sum("y").alias("k"), F.count("*").alias("n")]
        for i, (f, c) in enumerate(tests):
            exprs += [F.sum(F.when(F.col(f) <= c, F.col("y"))).alias(f"k{i}"), F.count_if(F.col(f) <= c).alias(f"n{i}")]
        split = {}
        for r in rows.groupBy("leaf").agg(*exprs).collect():  # at most 2**depth rows
            gini = lambda k, n: 2 * k * (n - k) / n if n else 0.0
            best = min(((gini(r[f"k{i}"] or 0.0, r[f"n{i}"]) + gini(r["k"] - (r[f"k{i}"] or 0.0), r["n"] - r[f"n{i}"]), i) for i in range(len(tests)) if min(r[f"n{i}"], r["n"] - r[f"n{i}"]) >= leaf), default=None)
            if best and best[0] < gini(r["k"], r["n"]) - 1e-12:
                split[r["leaf"]] = tests[best[1]]
        name = F.col("leaf")
        for at, (f, c) in split.items():
            name = F.when(F.col("leaf") == at, F.concat(F.lit(at), F.when(F.col(f) <= c, F.lit(f"[{f}<={c:g}]")).otherwise(F.lit(f"[{f}>{c:g}]")))).otherwise(name)
        rows = rows.withColumn("leaf", name)
    return rows.groupBy("leaf").agg(F.count("*").alias("n"), ((F.sum("y") + 1) / (F.count("*") + 2)).alias("rate"))


def cells_out_of_fold(df: DataFrame, features: list[str], label: str, fold: str, pseudo: float = 5.0) -> DataFrame:
    """df with `p`: the label's rate in the row's cell over the other folds, with `pseudo`
    rows at those folds' overall rate. Cells and folds are summed, rows are never paired."""
    cells = df.groupBy(fold, *features).agg(F.sum(label).alias("k"), F.count("*").alias("n"))
    own = Window.partitionBy(*features)
    rest = cells.select(fold, *features, (F.sum("k").over(own) - F.col("k")).alias("k"), (F.sum("n").over(own) - F.col("n")).alias("n"))
    folds_ = df.groupBy(fold).agg(F.sum(label).alias("fk"), F.count("*").alias("fn"))
    every = Window.partitionBy()
    prior = folds_.select(fold, ((F.sum("fk").over(every) - F.col("fk")) / (F.sum("fn").over(every) - F.col("fn"))).alias("prior"))  # a row a fold
    rate = rest.join(prior, fold).select(fold, *features, ((F.col("k") + pseudo * F.col("prior")) / (F.col("n") + pseudo)).alias("p"))
    return df.join(rate, [fold, *features])


def forward_selection(df: DataFrame, features: list[str], label: str, fold: str, make, gain: float = 0.0005) -> list[tuple[str, float]]:
    """(feature, loss) in the order in which they are taken: each step tries every feature
    that is left and keeps the one with the smallest cross-validated log-loss, while that
    falls by `gain` at least. make(df, features, label, fold) adds out-of-fold rates `p`;
    a try is one aggregate. Features must not be null."""
    taken: list[tuple[str, float]] = []
    best = make(df, [], label, fold).agg(log_loss(F.col("p"), F.col(label))).first()[0]
    while len(taken) < len(features):
        held = [f for f, _ in taken]
        losses = [(make(df, [*held, f], label, fold).agg(log_loss(F.col("p"), F.col(label))).first()[0], f) for f in features if f not in held]
        loss, name = min(losses)
        if best is None or loss > best - gain:
            break
        best = loss
        taken.append((name, loss))
    return taken
