"""What tasks that need other tasks can do: ready, waiting, doomed or caught in a circle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import kept


def circular(needs: DataFrame) -> DataFrame:
    """(task) of needs (task, need) that lie on a circle or behind one. Tasks without open
    needs are taken off round by round; each round joins only the last ones taken off."""
    edges = kept(needs.select("task", "need").where("task is not null and need is not null").distinct(), "needs")
    open_ = kept(edges.groupBy("task").agg(F.count("*").alias("n")), "open")
    frontier = kept(edges.select(F.col("need").alias("task")).distinct().join(open_, "task", "left_anti"), "frontier")
    while not frontier.isEmpty():
        less = edges.join(frontier.withColumnRenamed("task", "need"), "need").groupBy("task").agg(F.count("*").alias("gone"))
        left = kept(open_.join(less, "task", "left").select("task", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("n")), "open")
        frontier = kept(left.where("n = 0").select("task"), "frontier")
        open_ = left.where("n > 0")
    return open_.select("task")


def doomed(tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """(task) of open tasks that fail fast and need a failed task, or another doomed one."""
    edges = kept(needs.select("task", "need").where("task is not null and need is not null").distinct(), "needs")
    fast = kept(tasks.where("state = 'open' and policy = 'failFast'").select("task"), "fast")
    out = frontier = None
    found = tasks.where("state = 'failed'").select("task")
    while True:
        hit = edges.join(found.withColumnRenamed("task", "need"), "need").select("task").distinct().join(fast, "task", "left_semi")
        frontier = kept(hit if out is None else hit.join(out, "task", "left_anti"), "doomed")
        if frontier.isEmpty():
            return frontier if out is None else out
        out, found = frontier if out is None else kept(out.unionByName(frontier), "doomed"), frontier


def outlook(tasks: DataFrame, needs: DataFrame) -> DataFrame:
    """(task, state, outlook) of tasks (task, state, policy) and needs (task, need).

    state is done, failed or open, policy failFast or allSettled. Of an open task, outlook is
    circular (on a circle of needs or behind one), doomed (it fails fast, and something it
    needs failed or is doomed), ready (all it needs is done or, for allSettled, settled:
    done, failed or doomed), or waiting. A settled task's outlook is its state. A need that
    is no task never settles; a repeated need counts once; a null task has no row.
    """
    t = kept(tasks.select("task", "state", "policy").where("task is not null"), "tasks")
    edges = needs.select("task", "need").where("task is not null and need is not null").distinct()
    lost = circular(edges).withColumn("circular", F.lit(True))
    gone = doomed(t, edges).withColumn("doomed", F.lit(True))
    known = t.join(gone, "task", "left").select(F.col("task").alias("need"), F.when(F.coalesce("doomed", F.lit(False)), "failed").otherwise(F.col("state")).alias("came"))
    of = edges.join(known, "need", "left").groupBy("task").agg(F.count("*").alias("needs"), F.count_if(F.col("came") == "done").alias("done"), F.count_if(F.col("came").isin("done", "failed")).alias("settled"))
    rows = t.join(lost, "task", "left").join(gone, "task", "left").join(of, "task", "left")
    enough = F.when(F.col("policy") == "allSettled", F.col("settled")).otherwise(F.col("done"))
    ready = F.coalesce(F.col("needs"), F.lit(0)) == F.coalesce(enough, F.lit(0))
    view = F.when(F.col("state") != "open", F.col("state")).when(F.coalesce("circular", F.lit(False)), "circular").when(F.coalesce("doomed", F.lit(False)), "doomed").when(ready, "ready").otherwise("waiting")
    return rows.select("task", "state", view.alias("outlook"))
