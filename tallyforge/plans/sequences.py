"""Sequence analysis: carried state, segments, look-back, budgets, folds over order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..sources.tables import table
from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


def by_user() -> WindowSpec:
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def so_far() -> WindowSpec:
    return by_user().rowsBetween(Window.unboundedPreceding, 0)


def events(spark, d) -> DataFrame:
    return table(spark, d, "events")


@R.add("w1_cache_miss_scan", """
WITH s AS (SELECT *, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM events),
p AS (SELECT *, lag(value) OVER w AS prev, lag(event_type) OVER w AS prev_type, date_diff('microsecond', lag(ts) OVER w, ts) / 1e6 AS idle, bool_or(value > 30) OVER (PARTITION BY user_id, seg ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS reported
  FROM s WINDOW w AS (PARTITION BY user_id, seg ORDER BY ts, event_id))
SELECT event_id, round(least(prev, value) - value / 2, 6) AS missed, round(idle, 3) AS idle, prev_type <> event_type AS changed FROM p WHERE prev IS NOT NULL AND reported AND least(prev, value) - value / 2 > 4""")
def w1(spark, d) -> DataFrame:
    """Misses against the row before inside a segment that starts anew at each reset; counted once a hit was reported."""
    s = events(spark, d).withColumn("seg", F.count_if(F.col("event_type") == "signup").over(so_far()))
    w = Window.partitionBy("user_id", "seg").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    p = s.select(
        "event_id", "event_type", "value", F.lag("value").over(w).alias("prev"), F.lag("event_type").over(w).alias("prev_type"), ((us - F.lag(us).over(w)) / 1e6).alias("idle"),
        F.bool_or(F.col("value") > 30).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("reported"),
    )
    missed = F.least("prev", "value") - F.col("value") / 2
    return p.where(F.col("prev").isNotNull() & F.col("reported") & (missed > 4)).select("event_id", F.round(missed, 6).alias("missed"), F.round("idle", 3).alias("idle"), (F.col("prev_type") != F.col("event_type")).alias("changed"))


@R.add("w2_look_back_repeat", """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM events)
SELECT a.event_id, min(a.i - b.i) AS distance FROM o a JOIN o b ON a.user_id = b.user_id AND a.seg = b.seg AND a.event_type = b.event_type AND b.i < a.i AND a.i - b.i <= 6
WHERE a.event_type <> 'purchase' GROUP BY 1""")
def w2(spark, d) -> DataFrame:
    """Nearest equal action among the six before it, none across a changing action."""
    w6 = by_user().rowsBetween(-6, -1)
    seg = F.count_if(F.col("event_type") == "purchase").over(so_far())
    o = events(spark, d).withColumn("seg", seg).withColumn("back", F.reverse(F.collect_list(F.struct("event_type", "seg")).over(w6)))
    at = F.array_position(F.transform("back", lambda b: (b["event_type"] == F.col("event_type")) & (b["seg"] == F.col("seg"))), True)
    return o.where("event_type <> 'purchase'").select("event_id", at.alias("distance")).where("distance > 0")


@R.add("w4_failed_in_a_row", "SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE event_type = 'error' AND p = 'error'")
def w4(spark, d) -> DataFrame:
    two = F.min((F.col("event_type") == "error").cast("int")).over(by_user().rowsBetween(-1, 0))
    n = F.count("*").over(by_user().rowsBetween(-1, 0))
    return events(spark, d).select("event_id", two.alias("x"), n.alias("n")).where("x = 1 and n = 2").select("event_id")


@R.add("w5_exact_repeat_since_write", """
WITH s AS (SELECT *, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM events)
SELECT event_id FROM s QUALIFY row_number() OVER (PARTITION BY user_id, seg, event_type, props ORDER BY ts, event_id) > 1""")
def w5(spark, d) -> DataFrame:
    s = events(spark, d).withColumn("seg", F.count_if(F.col("event_type") == "purchase").over(so_far()))
    r = F.row_number().over(Window.partitionBy("user_id", "seg", "event_type", "props").orderBy("ts", "event_id"))
    return s.select("event_id", r.alias("r")).where("r > 1").select("event_id")


@R.add("w6_recent_windows", """
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS last_ten,
  count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000 RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS last_day FROM events""")
def w6(spark, d) -> DataFrame:
    sec = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).cast("long")
    e = events(spark, d).withColumn("sec", sec)
    day = Window.partitionBy("user_id").orderBy("sec").rangeBetween(-86400, 0)
    return e.select("event_id", F.count("*").over(by_user().rowsBetween(-9, 0)).alias("last_ten"), F.count("*").over(day).alias("last_day"))


@R.add("w7_first_last_trend", "SELECT user_id, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last, round(arg_max(value, (ts, event_id)) - arg_min(value, (ts, event_id)), 6) AS trend FROM events GROUP BY 1")
def w7(spark, d) -> DataFrame:
    o = F.struct("ts", "event_id")
    return events(spark, d).groupBy("user_id").agg(F.min_by("value", o).alias("first"), F.max_by("value", o).alias("last")).withColumn("trend", F.round(F.col("last") - F.col("first"), 6))


@R.add("w8_minutes_since_change", """
SELECT event_id, round(date_diff('microsecond', max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), ts) / 6e7, 4) AS minutes FROM events""")
def w8(spark, d) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    last = F.max(F.when(F.col("event_type") == "purchase", us)).over(so_far())
    return events(spark, d).select("event_id", F.round((us - last) / 6e7, 4).alias("minutes"))


@R.add("w9_tied_ranks", "SELECT doc_id, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS rank FROM documents")
def w9(spark, d) -> DataFrame:
    """Average ranks without a global window: counts per value, then offsets over value ranges."""
    t = table(spark, d, "documents").select("doc_id", "n_chars")
    return t.join(ranks(t.groupBy("n_chars").agg(F.count("*").alias("n")), "n_chars"), "n_chars").select("doc_id", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def ranks(counts: DataFrame, value: str, parts: int = 64) -> DataFrame:
    """counts (value, n) with `before`: how many rows have smaller values. Values are cut
    into ranges, so no task sorts all of them; the offsets of the ranges are a small join."""
    ranged = counts.repartitionByRange(parts, value).withColumn("_p", F.spark_partition_id())
    sums = ranged.groupBy("_p").agg(F.sum("n").alias("_n"))
    base = sums.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_base"))  # one row per range
    inside = F.sum("n").over(Window.partitionBy("_p").orderBy(value)) - F.col("n")
    return ranged.withColumn("_in", inside).join(F.broadcast(base), "_p").select(value, "n", (F.col("_base") + F.col("_in")).alias("before"))


@R.add("w10_position_band", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 5 THEN '1-5' ELSE '6+' END AS band FROM events")
def w10(spark, d) -> DataFrame:
    return events(spark, d).select("event_id", F.when(F.row_number().over(by_user()) <= 5, "1-5").otherwise("6+").alias("band"))


@R.add("w11_repeat_of_previous", "SELECT event_id, event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS same FROM events")
def w11(spark, d) -> DataFrame:
    return events(spark, d).select("event_id", (F.col("event_type") == F.lag("event_type").over(by_user())).alias("same"))


@R.add("w12_carried_forward", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS place FROM events")
def w12(spark, d) -> DataFrame:
    return events(spark, d).select("event_id", F.last(F.when(F.col("event_type") == "signup", F.col("props")), ignorenulls=True).over(so_far()).alias("place"))


@R.add("w13_budgeted_suffix", """
SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS s FROM conversations) WHERE s <= 800""")
def w13(spark, d) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "conversations").select("conv_id", "turn", F.sum(F.length("text")).over(w).alias("s")).where("s <= 800").select("conv_id", "turn")


@R.add("w14_settings_on_path", """
SELECT user_id, arg_max(value, (ts, event_id)) FILTER (WHERE event_type = 'click') AS level, arg_max(props, (ts, event_id)) FILTER (WHERE event_type = 'view') AS model FROM events GROUP BY 1""")
def w14(spark, d) -> DataFrame:
    o = lambda kind: F.when(F.col("event_type") == kind, F.struct("ts", "event_id"))
    return events(spark, d).groupBy("user_id").agg(F.max_by("value", o("click")).alias("level"), F.max_by("props", o("view")).alias("model"))


@R.add("w15_newest_edit_per_target", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def w15(spark, d) -> DataFrame:
    return events(spark, d).groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@R.add("w16_backward_cut_point", """
WITH r AS (SELECT conv_id, turn, role, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS s FROM conversations),
c AS (SELECT conv_id, max(turn) FILTER (WHERE s >= 600) AS reach FROM r GROUP BY 1)
SELECT conv_id, coalesce(min(turn) FILTER (WHERE role = 'user' AND turn >= reach), max(turn) FILTER (WHERE role = 'user')) AS cut FROM r JOIN c USING (conv_id) GROUP BY 1""")
def w16(spark, d) -> DataFrame:
    """From the newest row back until the kept size is reached; the first valid cut at or after it, else the last."""
    w = Window.partitionBy("conv_id")
    r = table(spark, d, "conversations").select("conv_id", "turn", "role", F.sum(F.length("text")).over(w.orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    r = r.withColumn("reach", F.max(F.when(F.col("s") >= 600, F.col("turn"))).over(w))
    user = F.col("role") == "user"
    return r.groupBy("conv_id").agg(F.coalesce(F.min(F.when(user & (F.col("turn") >= F.col("reach")), F.col("turn"))), F.max(F.when(user, F.col("turn")))).alias("cut"))


@R.add("w17_contiguous_blocks", """
SELECT user_id, event_type, CAST(count(*) FILTER (WHERE event_type IS DISTINCT FROM p) AS BIGINT) AS islands FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY 1, 2""")
def w17(spark, d) -> DataFrame:
    e = events(spark, d).select("user_id", "event_type", (~F.col("event_type").eqNullSafe(F.lag("event_type").over(by_user()))).alias("starts"))
    return e.groupBy("user_id", "event_type").agg(F.count_if("starts").alias("islands"))


@R.add("w18_backfill_until_next", """
WITH s AS (SELECT *, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS seg FROM events)
SELECT user_id, seg, count(*) AS n, round(sum(value) FILTER (WHERE event_type <> 'purchase'), 4) AS evidence FROM s GROUP BY 1, 2""")
def w18(spark, d) -> DataFrame:
    back = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    s = events(spark, d).withColumn("seg", F.count_if(F.col("event_type") == "purchase").over(back))
    return s.groupBy("user_id", "seg").agg(F.count("*").alias("n"), F.round(F.sum(F.when(F.col("event_type") != "purchase", F.col("value"))), 4).alias("evidence"))


@R.add("w19_first_row_per_key", "SELECT o_custkey, o_orderstatus, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) = 1")
def w19(spark, d) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


@R.add("w20_share_of_total", "SELECT c_mktsegment, round(sum(c_acctbal) / (SELECT sum(c_acctbal) FROM customer), 8) AS share FROM customer GROUP BY 1")
def w20(spark, d) -> DataFrame:
    g = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.sum("c_acctbal").alias("s"))
    return g.select("c_mktsegment", F.round(F.col("s") / F.sum("s").over(Window.partitionBy()), 8).alias("share"))


@R.add("w21_position_thirds", "SELECT event_id, CAST(least(2, 3 * (row_number() OVER w - 1) // count(*) OVER (PARTITION BY user_id)) AS INTEGER) AS third FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def w21(spark, d) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("user_id"))
    return events(spark, d).select("event_id", F.least(F.lit(2), F.floor(3 * (F.row_number().over(by_user()) - 1) / n)).cast("int").alias("third"))


@R.add("w22_two_previous", "SELECT event_id, concat_ws(',', lag(event_type, 2) OVER w, lag(event_type) OVER w) AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def w22(spark, d) -> DataFrame:
    return events(spark, d).select("event_id", F.array_join(F.collect_list("event_type").over(by_user().rowsBetween(-2, -1)), ",").alias("before"))


@R.add("w23_stint_length", """
WITH s AS (SELECT *, count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM events)
SELECT event_id, row_number() OVER (PARTITION BY user_id, seg ORDER BY ts, event_id) - CASE WHEN seg > 0 THEN 1 ELSE 0 END AS steps FROM s""")
def w23(spark, d) -> DataFrame:
    s = events(spark, d).withColumn("seg", F.count_if(F.col("event_type") == "signup").over(so_far()))
    r = F.row_number().over(Window.partitionBy("user_id", "seg").orderBy("ts", "event_id"))
    return s.select("event_id", (r - F.when(F.col("seg") > 0, 1).otherwise(0)).cast("long").alias("steps"))


@R.add("a46_funnel_per_kind", """
WITH n AS (SELECT *, lead(event_type) OVER w AS nxt, lead(event_type, 2) OVER w AS nxt2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_type AS kind, count(*) AS offered, count(*) FILTER (WHERE value > 20) AS chosen, count(*) FILTER (WHERE value > 20 AND nxt = 'purchase') AS used, count(*) FILTER (WHERE value > 20 AND (nxt = 'purchase' OR nxt2 = 'purchase')) AS anticipated FROM n GROUP BY 1""")
def a46(spark, d) -> DataFrame:
    n = events(spark, d).select("event_type", "value", F.lead("event_type").over(by_user()).alias("a"), F.lead("event_type", 2).over(by_user()).alias("b"))
    chosen = F.col("value") > 20
    one = F.coalesce(F.col("a") == "purchase", F.lit(False))
    two = F.coalesce(F.col("b") == "purchase", F.lit(False))
    return n.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("offered"), F.count_if(chosen).alias("chosen"), F.count_if(chosen & one).alias("used"), F.count_if(chosen & (one | two)).alias("anticipated"))


@R.add("a47_longest_identical_run", """
WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events),
c AS (SELECT user_id, event_type, g, count(*) AS n FROM r GROUP BY ALL)
SELECT user_id, max(n) AS longest, CAST(sum(n - 1) AS BIGINT) AS forced FROM c GROUP BY 1""")
def a47(spark, d) -> DataFrame:
    kind = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    r = events(spark, d).select("user_id", "event_type", (F.row_number().over(by_user()) - F.row_number().over(kind)).alias("g"))
    return r.groupBy("user_id", "event_type", "g").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"), F.sum(F.col("n") - 1).alias("forced"))


@R.add("a49_agreement_rates", """
SELECT round(avg(CASE WHEN a.event_type = b.event_type THEN 1.0 ELSE 0 END), 8) AS agreement, round(avg(CASE WHEN a.event_type = c.event_type THEN 1.0 ELSE 0 END), 8) AS self_agreement
FROM events a JOIN events b ON b.event_id = a.event_id + 1 JOIN events c ON c.event_id = a.event_id + 2""")
def a49(spark, d) -> DataFrame:
    e = events(spark, d)
    shifted = lambda k: e.select((F.col("event_id") - k).alias("event_id"), F.col("event_type").alias(f"t{k}"))
    j = e.select("event_id", "event_type").join(shifted(1), "event_id").join(shifted(2), "event_id")
    same = lambda k: F.round(F.avg((F.col("event_type") == F.col(f"t{k}")).cast("double")), 8)
    return j.agg(same(1).alias("agreement"), same(2).alias("self_agreement"))
