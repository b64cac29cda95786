"""Model contexts from paths of entries: results after their calls, compactions, edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordered_results(entries: DataFrame, session: str) -> DataFrame:
    """(session, place, shown, kind): each calling entry followed by one row per call.

    entries: session, id (orders a session), kind, calls (array, null where nothing is
    called) and answers (the call that an entry answers, else null). A call is answered by
    the first answer before the next calling entry; a call without one gives a row of kind
    `missing` with shown null; answers stand nowhere else, and unmatched ones are dropped.
    """
    turn = F.count_if(F.col("calls").isNotNull()).over(Window.partitionBy(session).orderBy("id").rowsBetween(Window.unboundedPreceding, 0))
    e = entries.withColumn("turn", turn)
    calls = e.where("calls is not null").select(session, "id", "turn", F.posexplode("calls").alias("nth", "call"))
    first = e.where("answers is not null and turn > 0").groupBy(session, "turn", F.col("answers").alias("call")).agg(F.min("id").alias("shown"))
    answered = calls.join(first, [session, "turn", "call"], "left").select(session, "id", (F.col("nth") + 1).alias("nth"), "shown", F.when(F.col("shown").isNull(), "missing").otherwise("result").alias("kind"))
    plain = e.where("answers is null").select(session, "id", F.lit(0).alias("nth"), F.col("id").alias("shown"), "kind")
    place = F.row_number().over(Window.partitionBy(session).orderBy("id", "nth"))
    return plain.unionByName(answered).withColumn("place", place.cast("long")).drop("id", "nth")


def context_entries(path: DataFrame, session: str) -> DataFrame:
    """Rows of path that the model sees, with `place` in their order.

    path: session, i (place on the path), compacts, keep_from (for a compaction the place of
    the first entry that it keeps) and system. The newest compaction comes first, then what
    it keeps (without system entries; nothing where keep_from is not on the path), then all
    after it. Older compactions are entries like others. Without one the path stays whole.
    """
    w = Window.partitionBy(session)
    newest = F.max(F.when(F.col("compacts"), F.struct("i", "keep_from"))).over(w)
    p = path.withColumn("_c", newest)
    at, first = F.col("_c")["i"], F.col("_c")["keep_from"]
    kept = (first >= 1) & (F.col("i") >= first) & ~F.col("system")
    order = F.when(F.col("_c").isNull() | (F.col("i") > at) | ((F.col("i") < at) & kept), F.col("i")).when(F.col("i") == at, 0)
    out = p.withColumn("_at", order).where("_at is not null")
    return out.withColumn("place", F.row_number().over(w.orderBy("_at")).cast("long")).drop("_c", "_at")


def newest_edit(edits: DataFrame, target: list[str], content: str) -> DataFrame:
    """(target, content) of the edit of each target with the largest `place`."""
    return edits.groupBy(*target).agg(F.max_by(content, "place").alias(content))
