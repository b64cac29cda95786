"""Connected components and root paths over edge tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept


def components(edges: DataFrame, nodes: DataFrame | None = None, keep: Callable[[DataFrame, str], DataFrame] = kept) -> DataFrame:
    """Components of the undirected graph `edges`(a, b): a row (node, component) per node,
    `component` being the smallest node of its component.

    `nodes`(node) adds nodes without edges; null ends are ignored, self links only name a
    node. Each round every node joins the neighbour (or itself) that comes first in a
    pseudo-random order of that round, and the graph is contracted; nodes and edges shrink
    by a constant factor, whatever the diameter. Hubs cost only map side minima and split
    joins. keep(df, name) writes the edges and each round to the shared folder.
    """
    given = keep(edges.select("a", "b").where("a is not null and b is not null"), "edges-given")  # read three times below
    every = given.select(F.col("a").alias("node")).unionAll(given.select(F.col("b").alias("node")))
    if nodes is not None:
        every = every.unionAll(nodes.select("node").where("node is not null"))
    e = keep(given.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = every.distinct().select("node", F.col("node").alias("rep"))
    turn = 0
    while not e.isEmpty():
        turn += 1
        order = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("n"))
        both = e.select(F.col("a").alias("v"), order("b").alias("o")).unionAll(e.select(F.col("b").alias("v"), order("a").alias("o")))
        to = both.groupBy("v").agg(F.min("o").alias("o")).select("v", F.least("o", order("v"))["n"].alias("m"))
        to = keep(to, "hooks")
        labels = labels.join(to, labels["rep"] == to["v"], "left").select("node", F.coalesce("m", "rep").alias("rep"))
        labels = keep(labels, "labels")
        ta, tb = to.select(F.col("v").alias("a"), F.col("m").alias("ma")), to.select(F.col("v").alias("b"), F.col("m").alias("mb"))
        e = e.join(ta, "a").join(tb, "b").where("ma <> mb").select(F.least("ma", "mb").alias("a"), F.greatest("ma", "mb").alias("b")).distinct()
        e = keep(e, "edges")
    smallest = labels.groupBy("rep").agg(F.min("node").alias("component"))
    return labels.join(smallest, "rep").select("node", "component")


def alike(df: DataFrame, node: str, key: F.Column) -> DataFrame:
    """Edges (a, b) from each node to the smallest node with the same key: one edge a node,
    never the pairs of a key. Minima are taken before the shuffle. Null keys link nothing."""
    t = df.select(F.col(node).alias("a"), key.alias("k")).where("k is not null")
    return t.join(t.groupBy("k").agg(F.min("a").alias("b")), "k").select("a", "b")


def _jumps(parents: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(jumps, circular): tables (node, up) of the ancestor 1, 2, 4, ... above a node, and
    the nodes (node) whose way up never ends. No way without a circle is longer than there
    are nodes, so what still has an ancestor that far above goes round."""
    state = parents.select("node", F.col("parent").alias("up")).where("up is not null").checkpoint()
    jumps, most = [], parents.count()
    while not state.isEmpty() and 2 ** len(jumps) <= most:
        jumps.append(state)
        state = state.join(state.select(F.col("node").alias("up"), F.col("up").alias("up2")), "up").select("node", F.col("up2").alias("up")).checkpoint()
    return jumps, state.select("node").distinct()


def circular(parents: DataFrame) -> DataFrame:
    """The nodes of parents (node, parent) whose way up leads into a circle."""
    return _jumps(parents)[1]


def root_paths(parents: DataFrame) -> DataFrame:
    """(node, ancestor, distance) for parents (node, parent): each node, then up to its root.
    A node whose way up leads into a circle has no path and no rows: circular() lists those."""
    jumps, lost = _jumps(parents)
    out = parents.select("node").join(lost, "node", "left_anti").select("node", F.col("node").alias("ancestor"), F.lit(0).alias("distance"))
    for i, jump in enumerate(jumps):
        # what is known reaches 2 ** i - 1 up; add the same again, seen from the node 2 ** i above
        more = out.join(jump.withColumnRenamed("node", "ancestor"), "ancestor").select("node", F.col("up").alias("ancestor"), (F.col("distance") + 2**i).alias("distance"))
        out = out.unionByName(more).checkpoint()
    return out


def fork_chain(forks: DataFrame) -> DataFrame:
    """(node, ancestor, distance, limit) of a fork tree (node, parent, cut): what a node sees
    of an ancestor ends at `limit`, the smallest cut on the way; null for the node itself."""
    paths = root_paths(forks.select("node", "parent"))
    cuts = paths.join(forks.select(F.col("node").alias("ancestor"), "cut"), "ancestor")
    w = Window.partitionBy("node").orderBy("distance").rowsBetween(Window.unboundedPreceding, -1)
    return cuts.select("node", "ancestor", "distance", F.min("cut").over(w).alias("limit"))
