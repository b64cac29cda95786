"""Reports of paired runs, coverage and traces, checkpoint features, policy sweeps, and
operators that take functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import models, pairing, summaries
from ..operators.quantiles import with_quantiles
from ..sources.tables import table
from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

_K = "CAST(json_extract(props, '$.k') AS BIGINT)"


def by_customer(spark, d, priority: str) -> DataFrame:
    o = table(spark, d, "orders").where(F.col("o_orderpriority") == priority)
    return o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("wall"), F.count("*").cast("double").alias("model"), (F.max("o_totalprice") > 250000).alias("passed"))


_PAIRS = """
WITH s AS (SELECT o_custkey, o_orderpriority AS p, sum(o_totalprice) AS wall, CAST(count(*) AS DOUBLE) AS model, max(o_totalprice) > 250000 AS ok FROM orders GROUP BY 1, 2),
j AS (SELECT a.o_custkey, a.wall AS bw, b.wall AS aw, a.model AS bq, b.model AS aq, a.ok AS bp, b.ok AS ap FROM s a JOIN s b ON a.o_custkey = b.o_custkey WHERE a.p = '{base}' AND b.p = '{arm}') """


_TIMES = {"wall": "wall", "model": "model"}
#: Group -> its condition on the flags of a pair.
_WITHIN = {"all": "TRUE", "baseline_passed": "bp", "both_passed": "bp AND ap"}


def _measures_sql() -> str:
    """The measures of j's pairs in SQL, a column each."""
    out = ["1 AS pairs", "bp::INTEGER AS base_passes", "ap::INTEGER AS arm_passes", "(bp AND NOT ap)::INTEGER AS only_base_passes", "(ap AND NOT bp)::INTEGER AS only_arm_passes", "(bp AND ap)::INTEGER AS both_pass"]
    for time, x, y in (("wall", "bw", "aw"), ("model", "bq", "aq")):
        for group, holds in _WITHIN.items():
            out.append(f"({holds} AND {x} IS NOT NULL AND {y} IS NOT NULL)::INTEGER AS {group}_{time}_n")
            out += [f"round(CASE WHEN {holds} AND {x} IS NOT NULL AND {y} IS NOT NULL THEN {v} ELSE 0 END, 4) AS {group}_{time}_{side}" for side, v in (("base", x), ("arm", y))]
            out.append(f"round(CASE WHEN {holds} AND {x} > 0 AND {y} > 0 THEN ln({y} / {x}) END, 8) AS {group}_{time}_log")
        out.append(f"coalesce({x} <= 0 OR {y} <= 0, FALSE)::INTEGER AS {time}_unusable")
    return ", ".join(out)


def _measured(spark, d) -> DataFrame:
    p = pairing.paired(by_customer(spark, d, "1-URGENT"), by_customer(spark, d, "5-LOW"), "o_custkey").where("state = 'paired'")
    return pairing.pair_measures(p, "passed", _TIMES)


@R.add("f15_pair_measures", _PAIRS.format(base="1-URGENT", arm="5-LOW") + f"SELECT o_custkey, {_measures_sql()} FROM j")
def f15(spark, d) -> DataFrame:
    m, digits = _measured(spark, d), {"log": 8, "base": 4, "arm": 4}
    names = pairing.measures_of("passed", _TIMES)
    return m.select("o_custkey", *[F.round(n, digits[n.rsplit("_", 1)[-1]]).alias(n) if n.rsplit("_", 1)[-1] in digits else F.col(n) for n in names])


@R.add("f15_summed_measures", _PAIRS.format(base="1-URGENT", arm="5-LOW") + f""", m AS (SELECT o_custkey, bw, aw, {_measures_sql()} FROM j)
SELECT c_nationkey, CAST(sum(pairs) AS BIGINT) AS pairs, CAST(sum(both_pass) AS BIGINT) AS both_pass, CAST(sum(model_unusable) AS BIGINT) AS model_unusable, count(both_passed_wall_log) AS n_logs, round(list_min(list(bw)), 4) AS least_base, round(list_max(list(aw)), 4) AS most_arm, len(list(bw)) AS n_walls
FROM m JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def f15_summed(spark, d) -> DataFrame:
    """Measures of pairs added up by nation, logarithms and wall times as lists."""
    m = _measured(spark, d).join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    s = pairing.summed_measures(m, ["c_nationkey"], "passed", _TIMES)
    n_logs = F.size(F.coalesce("both_passed_wall_log", F.array())).cast("long")
    return s.select("c_nationkey", "pairs", "both_pass", "model_unusable", n_logs.alias("n_logs"), F.round(F.array_min("wall_base_list"), 4).alias("least_base"), F.round(F.array_max("wall_arm_list"), 4).alias("most_arm"), F.size("wall_base_list").cast("long").alias("n_walls"))


@R.add("j5_model_study_pairs", _PAIRS.format(base="2-HIGH", arm="3-MEDIUM") + "SELECT o_custkey, round(aw / bw, 6) AS wall_ratio, ap = bp AS same FROM j")
def j5(spark, d) -> DataFrame:
    p = pairing.paired(by_customer(spark, d, "2-HIGH"), by_customer(spark, d, "3-MEDIUM"), "o_custkey").where("state = 'paired'")
    return p.select("o_custkey", F.round(F.col("arm_wall") / F.col("base_wall"), 6).alias("wall_ratio"), (F.col("arm_passed") == F.col("base_passed")).alias("same"))


@R.add("a19_arm_profile", """
WITH s AS (SELECT o_orderpriority AS arm, o_orderkey, o_orderstatus, count(l_linenumber) AS turns, count(*) FILTER (WHERE l_returnflag = 'R') AS off, count(*) FILTER (WHERE l_quantity > 45) AS guard, CAST(sum(l_linenumber) AS BIGINT) AS steps FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)
SELECT arm, count(*) AS sessions, count(*) FILTER (WHERE turns > 0) AS traced, CAST(sum(turns) AS BIGINT) AS turns, CAST(sum(off) FILTER (WHERE turns > 0) AS BIGINT) AS turns_off, CAST(sum(guard) FILTER (WHERE turns > 0) AS BIGINT) AS guards, CAST(sum(steps) FILTER (WHERE turns > 0) AS BIGINT) AS steps,
  count(*) FILTER (WHERE o_orderstatus = 'P') AS time_limit, count(*) FILTER (WHERE o_orderstatus = 'O') AS error_open FROM s GROUP BY 1""")
def a19(spark, d) -> DataFrame:
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("turns"), F.count_if(F.col("l_returnflag") == "R").alias("off"), F.count_if(F.col("l_quantity") > 45).alias("guard"), F.sum("l_linenumber").alias("steps"))
    s = table(spark, d, "orders").join(l, "o_orderkey", "left")
    st = F.col("o_orderstatus")
    return s.groupBy(F.col("o_orderpriority").alias("arm")).agg(
        F.count("*").alias("sessions"), F.count("turns").alias("traced"), F.sum(F.coalesce("turns", F.lit(0))).alias("turns"), F.sum("off").alias("turns_off"), F.sum("guard").alias("guards"), F.sum("steps").alias("steps"),
        F.count_if(st == "P").alias("time_limit"), F.count_if(st == "O").alias("error_open"),
    )


@R.add("a31_coverage_summary", f"""
WITH e AS (SELECT event_type AS kind, user_id AS task, {_K} AS k, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events), c AS (SELECT *, value > 30 AS covered FROM e WHERE kind <> 'error'),
g AS (SELECT 'kind' AS part, kind AS name, * FROM c UNION ALL SELECT 'task', CAST(task AS VARCHAR), * FROM c UNION ALL SELECT 'position', CASE WHEN turn <= 5 THEN 'turns 1-5' ELSE 'turns 6+' END, * FROM c UNION ALL SELECT 'all', 'all', * FROM c)
SELECT part, name, count(*) AS counted, count(*) FILTER (WHERE covered) AS covered, round(count(*) FILTER (WHERE covered) / count(*), 8) AS coverage, median(k) AS menu, list_sort(list(k))[1 + least(count(*) - 1, CAST(floor(0.95 * count(*)) AS BIGINT))] AS menu_p95, count(*) FILTER (WHERE covered) / count(*) >= 0.25 AS gate FROM g GROUP BY 1, 2""")
def a31(spark, d) -> DataFrame:
    """Counts and shares by kind, by task, by position and in all; menu sizes by median and floor-index p95."""
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, d, "events").select("event_type", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), (F.col("value") > 30).alias("covered"), turn.alias("turn")).where("event_type <> 'error'")
    part = lambda p, name: F.struct(F.lit(p).alias("part"), name.alias("name"))
    names = F.array(part("kind", F.col("event_type")), part("task", F.col("user_id").cast("string")), part("position", F.when(F.col("turn") <= 5, "turns 1-5").otherwise("turns 6+")), part("all", F.lit("all")))
    g = e.select(F.explode(names).alias("g"), "k", "covered").select("g.part", "g.name", "k", "covered")
    hits = F.count_if("covered")
    s = g.groupBy("part", "name").agg(F.count("*").alias("counted"), hits.alias("covered"), F.round(hits / F.count("*"), 8).alias("coverage"), (hits / F.count("*") >= 0.25).alias("gate"))
    return with_quantiles(s, g.select("part", "name", "k"), ["part", "name"], "k", {"menu": ("cont", 0.5), "menu_p95": ("floor", 0.95)})


@R.add("a17_trace_counters", f"""
WITH e AS (SELECT user_id, event_type AS t, value, {_K} AS k, ts, event_id FROM events)
SELECT user_id, count(*) AS turns, count(*) FILTER (WHERE t = 'error') AS errors, count(*) FILTER (WHERE t = 'click') AS clicks, count(*) FILTER (WHERE t = 'view') AS views, count(*) FILTER (WHERE t = 'purchase') AS purchases, count(*) FILTER (WHERE t = 'signup') AS signups,
  round(sum(value) FILTER (WHERE t = 'purchase'), 4) AS spent, round(sum(value), 4) AS total, CAST(sum(k) AS BIGINT) AS k_sum, max(k) AS k_most, count(*) FILTER (WHERE k > 90) AS cuts, count(*) FILTER (WHERE k < 10 AND t <> 'error') AS steps, count(DISTINCT t) AS kinds,
  array_to_string(list_transform(list_sort(list(DISTINCT t)), lambda x: x), ',') AS names, array_to_string(list_sort(list(k) FILTER (WHERE t = 'view')), ',') AS view_ks, min(event_id) AS first, max(event_id) AS last FROM e GROUP BY 1""".replace("list_transform(list_sort(list(DISTINCT t)), lambda x: x)", "list_sort(list(DISTINCT t))"))
def a17(spark, d) -> DataFrame:
    """Counters, sums and lists of one session's trace; the list of a session's latencies is the result asked for."""
    t, k, v = F.col("t"), F.col("k"), F.col("value")
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("t"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_id")
    n = lambda kind: F.count_if(t == kind)
    ks = F.array_join(F.sort_array(F.collect_list(F.when(t == "view", k))).cast("array<string>"), ",")
    return e.groupBy("user_id").agg(
        F.count("*").alias("turns"), n("error").alias("errors"), n("click").alias("clicks"), n("view").alias("views"), n("purchase").alias("purchases"), n("signup").alias("signups"),
        F.round(F.sum(F.when(t == "purchase", v)), 4).alias("spent"), F.round(F.sum(v), 4).alias("total"), F.sum(k).alias("k_sum"), F.max(k).alias("k_most"), F.count_if(k > 90).alias("cuts"), F.count_if((k < 10) & (t != "error")).alias("steps"), F.countDistinct(t).alias("kinds"),
        F.array_join(F.array_sort(F.collect_set(t)), ",").alias("names"), F.when(n("view") > 0, ks).alias("view_ks"), F.min("event_id").alias("first"), F.max("event_id").alias("last"),
    )


@R.add("a48_combined_saving", f"""
WITH e AS (SELECT user_id, CASE WHEN event_type = 'purchase' AND value > 20 THEN value ELSE 0 END AS menu, CASE WHEN event_type IN ('click', 'purchase') AND {_K} < 40 THEN value / 2 - 1 ELSE 0 END AS route, CASE WHEN {_K} > 90 THEN 1.5 ELSE 0 END AS trim, event_type = 'purchase' AND value > 20 AS covered FROM events)
SELECT user_id, round(sum(CASE WHEN covered THEN menu ELSE route + trim END), 4) AS saving, count(*) FILTER (WHERE covered) AS covered, count(*) FILTER (WHERE NOT covered AND route <> 0) AS routed, count(*) FILTER (WHERE NOT covered AND trim > 0) AS trimmed FROM e GROUP BY 1""")
def a48(spark, d) -> DataFrame:
    """Three decisions a turn: a covered turn is saved whole; only others gain by a cheaper level and by a trimmed output."""
    t, k, v = F.col("event_type"), F.get_json_object("props", "$.k").cast("long"), F.col("value")
    covered = (t == "purchase") & (v > 20)
    route = F.when(t.isin("click", "purchase") & (k < 40), v / 2 - 1).otherwise(0.0)
    trim = F.when(k > 90, 1.5).otherwise(0.0)
    e = table(spark, d, "events").select("user_id", covered.alias("c"), v.alias("menu"), route.alias("route"), trim.alias("trim"))
    return e.groupBy("user_id").agg(
        F.round(F.sum(F.when(F.col("c"), F.col("menu")).otherwise(F.col("route") + F.col("trim"))), 4).alias("saving"), F.count_if("c").alias("covered"), F.count_if(~F.col("c") & (F.col("route") != 0)).alias("routed"), F.count_if(~F.col("c") & (F.col("trim") > 0)).alias("trimmed"),
    )


# checkpoints

_FEATURES = {
    # name: (SQL over e, Column over the same names)
    "turns": "count(*)", "clicks": "count(*) FILTER (WHERE t = 'click')", "views": "count(*) FILTER (WHERE t = 'view')", "purchases": "count(*) FILTER (WHERE t = 'purchase')", "signups": "count(*) FILTER (WHERE t = 'signup')",
    "failed": "count(*) FILTER (WHERE t = 'error')", "fail_share": "round(count(*) FILTER (WHERE t = 'error') / count(*), 8)", "fail_share_recent": "round(count(*) FILTER (WHERE t = 'error' AND back <= 10) / count(*) FILTER (WHERE back <= 10), 8)", "turns_per_day": "round(count(*) / cut, 8)",
    "turns_last_day": "count(*) FILTER (WHERE day >= cut - 1)", "spent": "round(sum(value) FILTER (WHERE t = 'purchase'), 4)", "spent_recent": "round(sum(value) FILTER (WHERE t = 'purchase' AND back <= 10), 4)", "value_total": "round(sum(value), 4)", "value_mean": "round(CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) / count(value), 6)", "value_most": "max(value)",
    "k_total": "CAST(sum(k) AS BIGINT)", "k_last": "max(k) FILTER (WHERE back = 1)", "k_first": "max(k) FILTER (WHERE i = 1)", "k_trend": "max(k) FILTER (WHERE back = 1) - max(k) FILTER (WHERE i = 1)", "kinds": "count(DISTINCT t)", "distinct_ks": "count(DISTINCT k)",
    "repeat_share": "round(1 - count(DISTINCT k) / count(*), 8)", "near_repeat_share": "round(1 - count(DISTINCT k // 10) / count(*), 8)", "large": "count(*) FILTER (WHERE value > 100)", "large_recent": "count(*) FILTER (WHERE value > 100 AND back <= 10)", "tests": "count(*) FILTER (WHERE t = 'view' AND k > 50)",
    "last_failed": "CAST(max(CASE WHEN back = 1 AND t = 'error' THEN 1 ELSE 0 END) AS INTEGER)", "changes": "count(*) FILTER (WHERE t IN ('purchase', 'signup'))", "changes_recent": "count(*) FILTER (WHERE t IN ('purchase', 'signup') AND back <= 10)", "since_change": "cut - coalesce(max(day) FILTER (WHERE t IN ('purchase', 'signup')), 0)",
    "timeouts": "count(*) FILTER (WHERE k >= 95)", "not_found": "count(*) FILTER (WHERE k BETWEEN 40 AND 44)", "guard_hits": "count(*) FILTER (WHERE k = 13)", "output_recent": "round(avg(value) FILTER (WHERE back <= 5), 6)", "days_active": "count(DISTINCT day)", "off_share": "round(count(*) FILTER (WHERE k % 2 = 0) / count(*), 8)",
    "first_day": "min(day)", "errors_after_first_change": "count(*) FILTER (WHERE t = 'error' AND changed)",
}


@R.add("m11_checkpoint_features", f"""
WITH b AS (SELECT user_id, cut, event_type AS t, value, {_K} AS k, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, ts, event_id FROM events JOIN (VALUES (5), (10), (20), (30)) c(cut) ON ts < TIMESTAMP '2024-01-01' + INTERVAL (cut) DAY),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id, cut ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY user_id, cut ORDER BY ts DESC, event_id DESC) AS back, coalesce(bool_or(t IN ('purchase', 'signup')) OVER (PARTITION BY user_id, cut ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS changed FROM b)
SELECT user_id, cut, {', '.join(f'{sql} AS {name}' for name, sql in _FEATURES.items())} FROM e GROUP BY user_id, cut""")
def m11(spark, d) -> DataFrame:
    """38 features of what a session did up to each checkpoint."""
    days = F.datediff("ts", F.lit("2024-01-01"))
    cuts = F.filter(F.array(*map(F.lit, (5, 10, 20, 30))), lambda c: days < c)
    b = table(spark, d, "events").select("user_id", F.explode(cuts).alias("cut"), F.col("event_type").alias("t"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"), days.cast("long").alias("day"), "ts", "event_id")
    w = Window.partitionBy("user_id", "cut")
    change = F.col("t").isin("purchase", "signup")
    e = b.withColumn("i", F.row_number().over(w.orderBy("ts", "event_id"))).withColumn("back", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))))
    e = e.withColumn("changed", F.coalesce(F.bool_or(change).over(w.orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    t, k, v, recent, n = F.col("t"), F.col("k"), F.col("value"), F.col("back") <= 10, F.count("*")
    at = lambda c: F.max(F.when(c, k))
    cut = F.first("cut")
    share = lambda a, b: F.round(a / b, 8)
    made = {
        "turns": n, "clicks": F.count_if(t == "click"), "views": F.count_if(t == "view"), "purchases": F.count_if(t == "purchase"), "signups": F.count_if(t == "signup"), "failed": F.count_if(t == "error"), "fail_share": share(F.count_if(t == "error"), n),
        "fail_share_recent": share(F.count_if((t == "error") & recent), F.count_if(recent)), "turns_per_day": share(n, cut), "turns_last_day": F.count_if(F.col("day") >= F.col("cut") - 1), "spent": F.round(F.sum(F.when(t == "purchase", v)), 4), "spent_recent": F.round(F.sum(F.when((t == "purchase") & recent, v)), 4),
        "value_total": F.round(F.sum(v), 4), "value_mean": F.round(F.try_divide(F.sum(v.cast("decimal(18,4)")).cast("double"), F.count(v)), 6), "value_most": F.max(v), "k_total": F.sum(k), "k_last": at(F.col("back") == 1), "k_first": at(F.col("i") == 1), "k_trend": at(F.col("back") == 1) - at(F.col("i") == 1), "kinds": F.countDistinct(t), "distinct_ks": F.countDistinct(k),
        "repeat_share": F.round(1 - F.countDistinct(k) / n, 8), "near_repeat_share": F.round(1 - F.countDistinct(F.floor(k / 10)) / n, 8), "large": F.count_if(v > 100), "large_recent": F.count_if((v > 100) & recent), "tests": F.count_if((t == "view") & (k > 50)),
        "last_failed": F.max(F.when((F.col("back") == 1) & (t == "error"), 1).otherwise(0)), "changes": F.count_if(change), "changes_recent": F.count_if(change & recent), "since_change": cut - F.coalesce(F.max(F.when(change, F.col("day"))), F.lit(0)), "timeouts": F.count_if(k >= 95),
        "not_found": F.count_if(k.between(40, 44)), "guard_hits": F.count_if(k == 13), "output_recent": F.round(F.avg(F.when(F.col("back") <= 5, v)), 6), "days_active": F.countDistinct("day"), "off_share": share(F.count_if(k % 2 == 0), n), "first_day": F.min("day"), "errors_after_first_change": F.count_if((t == "error") & F.col("changed")),
    }
    return e.groupBy("user_id", "cut").agg(*[c.alias(name) for name, c in made.items()])


# sweeps

_L = "l AS (SELECT doc_id, n_chars, quality, toxic FROM labels JOIN documents USING (doc_id))"


@R.add("m8_policy_sweep", f"""
WITH {_L}, s AS (SELECT m, n_chars * (1 + m * toxic) / (1 + m * quality / 10.0) AS score, n_chars, quality FROM l, range(11) r(m)), p AS (SELECT unnest(range(60)) AS step),
o AS (SELECT m, step, count(*) FILTER (WHERE score < 100 * step) AS stopped, count(*) FILTER (WHERE score < 100 * step AND quality = 1) AS lost, CAST(sum(CASE WHEN score < 100 * step THEN least(n_chars, 50 * step) ELSE n_chars END) AS BIGINT) AS cost, CAST(sum(n_chars) AS BIGINT) AS whole, count(*) FILTER (WHERE quality = 1) AS good FROM s, p GROUP BY 1, 2),
b AS (SELECT budget, m, step, stopped, lost, cost, whole, row_number() OVER (PARTITION BY budget ORDER BY cost, step DESC, m) AS r FROM o, (VALUES (0), (5), (20)) x(budget) WHERE lost * 100 <= budget * good)
SELECT budget, m AS mode, step, stopped, lost, round(cost / whole, 8) AS cost FROM b WHERE r = 1""")
def m8(spark, d) -> DataFrame:
    """11 scores x 60 thresholds; of the policies that lose no more of the good than the budget
    in percent the cheapest, then the one with the higher threshold. Rows meet each policy
    inside one aggregate: only (policy) sums are shuffled."""
    l = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    s = l.select("n_chars", "quality", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda m: F.col("n_chars") * (1 + m * F.col("toxic")) / (1 + m * F.col("quality") / 10.0))).alias("m", "score"))
    x = s.select("*", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("step"))
    stop, good = F.col("score") < 100 * F.col("step"), F.col("quality") == 1
    o = x.groupBy("m", "step").agg(F.count_if(stop).alias("stopped"), F.count_if(stop & good).alias("lost"), F.sum(F.when(stop, F.least("n_chars", (50 * F.col("step")).cast("long"))).otherwise(F.col("n_chars"))).alias("cost"), F.sum("n_chars").alias("whole"), F.count_if(good).alias("good"))
    b = o.select("*", F.explode(F.array(*map(F.lit, (0, 5, 20)))).alias("budget")).where("lost * 100 <= budget * good")
    best = b.groupBy("budget").agg(F.min_by(F.struct("m", "step", "stopped", "lost", "cost", "whole"), F.struct("cost", -F.col("step"), "m")).alias("b"))
    return best.select("budget", F.col("b.m").cast("long").alias("mode"), F.col("b.step").cast("long").alias("step"), "b.stopped", "b.lost", F.round(F.col("b.cost") / F.col("b.whole"), 8).alias("cost"))


_OUTCOME = "CASE WHEN p >= k / 10 AND toxic = 0 THEN 'right' WHEN p >= k / 10 THEN 'wrong' WHEN toxic = 0 THEN 'missed' ELSE 'left' END"


@R.add("m9_threshold_sweep", f"""
WITH t AS (SELECT unnest(range(1, 10)) AS k), l AS (SELECT least(n_chars / 5000.0, 1) AS p, toxic FROM labels JOIN documents USING (doc_id)), o AS (SELECT k, {_OUTCOME} AS outcome FROM t, l)
SELECT k, outcome, count(*) AS turns, count(*) * CASE outcome WHEN 'right' THEN 1 WHEN 'wrong' THEN -2 ELSE 0 END AS saving, CAST(sum(count(*) * CASE outcome WHEN 'right' THEN 1 WHEN 'wrong' THEN -2 ELSE 0 END) OVER (PARTITION BY k) AS BIGINT) AS net FROM o GROUP BY k, outcome""")
def m9(spark, d) -> DataFrame:
    """The outcome of every turn at every threshold, counted, with its saving and the threshold's net."""
    p = F.least(F.col("n_chars") / 5000.0, F.lit(1.0))
    l = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(p.alias("p"), "toxic", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("k"))
    on, fine = F.col("p") >= F.col("k") / 10, F.col("toxic") == 0
    outcome = F.when(on & fine, "right").when(on, "wrong").when(fine, "missed").otherwise("left")
    g = l.groupBy(F.col("k").cast("long").alias("k"), outcome.alias("outcome")).agg(F.count("*").alias("turns"))
    saving = F.col("turns") * F.when(F.col("outcome") == "right", 1).when(F.col("outcome") == "wrong", -2).otherwise(0)
    return g.select("k", "outcome", "turns", saving.alias("saving"), F.sum(saving).over(Window.partitionBy("k")).alias("net"))  # four rows a threshold


@R.add("m10_prediction_comparison", f"""
WITH {_L}, a AS (SELECT doc_id, n_chars > 1000 AS x FROM l), b AS (SELECT doc_id, n_chars > 400 + 900 * toxic AS y, quality FROM l WHERE doc_id % 10 <> 3), j AS (SELECT x, y, quality = 1 AS truth FROM a FULL JOIN b USING (doc_id))
SELECT CASE WHEN x IS NULL THEN 'only second' WHEN y IS NULL THEN 'only first' WHEN x = y THEN 'same' WHEN truth = y THEN 'mended' ELSE 'broken' END AS change, count(*) AS n FROM j GROUP BY 1""")
def m10(spark, d) -> DataFrame:
    """Two sets of predictions met by id: what flipped, and for better or worse."""
    l = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    a = l.select("doc_id", (F.col("n_chars") > 1000).alias("x"))
    b = l.where("doc_id % 10 <> 3").select("doc_id", (F.col("n_chars") > 400 + 900 * F.col("toxic")).alias("y"), (F.col("quality") == 1).alias("truth"))
    j = a.join(b, "doc_id", "full")
    change = F.when(F.col("x").isNull(), "only second").when(F.col("y").isNull(), "only first").when(F.col("x") == F.col("y"), "same").when(F.col("truth") == F.col("y"), "mended").otherwise("broken")
    return j.groupBy(change.alias("change")).agg(F.count("*").alias("n"))


@R.add("m7_forward_selection")
def m7(spark, d) -> DataFrame:
    """Features picked one by one while the cross-validated log-loss falls by 0.0005 at least
    (no SQL twin: tested against a plain version)."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", (F.col("n_chars") > 1000).alias("big"), F.floor(F.log1p("n_chars")).alias("order"))
    l = table(spark, d, "labels").select("doc_id", "quality").join(docs, "doc_id")
    fold = F.conv(F.substring(F.sha2(F.concat(F.lit("8:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 13), 16, 10).cast("long") % 5
    steps = models.forward_selection(l.withColumn("fold", fold), ["lang", "big", "order", "source"], "quality", "fold", models.cells_out_of_fold)
    return spark.createDataFrame([(i + 1, f, round(loss, 8)) for i, (f, loss) in enumerate(steps)], "step int, feature string, loss double")


@R.add("p4_model_factory", """
WITH l AS (SELECT doc_id, lang, quality, CAST('0x' || substr(sha256('8:' || doc_id), 1, 13) AS BIGINT) % 5 AS fold FROM labels JOIN documents USING (doc_id)), t AS (SELECT lang, fold, sum(quality) AS k, count(*) AS n FROM l GROUP BY 1, 2), a AS (SELECT lang, sum(k) AS k, sum(n) AS n FROM t GROUP BY 1), f AS (SELECT fold, sum(quality) AS k, count(*) AS n FROM l GROUP BY 1), w AS (SELECT sum(k) AS k, sum(n) AS n FROM f),
p AS (SELECT quality AS y, (a.k - t.k + 5 * (w.k - f.k) / (w.n - f.n)) / (a.n - t.n + 5) AS p FROM l JOIN t USING (lang, fold) JOIN a USING (lang) JOIN f USING (fold), w)
SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 8) AS loss FROM p""")
def p4(spark, d) -> DataFrame:
    """Cross-validated loss of a model that the caller makes: here smoothed cells by language."""
    l = table(spark, d, "labels").select("doc_id", "quality").join(table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    fold = F.conv(F.substring(F.sha2(F.concat(F.lit("8:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 13), 16, 10).cast("long") % 5
    out = models.cells_out_of_fold(l.withColumn("fold", fold), ["lang"], "quality", "fold")
    return out.agg(F.round(models.log_loss(F.col("p"), F.col("quality")), 8).alias("loss"))


# functions as arguments


@R.add("p1_key_functions", "SELECT CASE WHEN event_type = 'error' THEN 'bad' ELSE 'good' END || ':' || hour(ts) // 6 AS key, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def p1(spark, d) -> DataFrame:
    """Summaries by a key that a function of the frame makes."""
    quarter = lambda df: F.concat(F.when(df["event_type"] == "error", "bad").otherwise("good"), F.lit(":"), F.floor(F.hour(df["ts"]) / 6).cast("string"))
    return summaries.summarised(table(spark, d, "events"), quarter, {"n": lambda df: F.count("*"), "total": lambda df: F.round(F.sum(df["value"]), 4)})


@R.add("p2_statistics_over_clusters", """
WITH s AS (SELECT c_nationkey AS c, sum(o_totalprice) AS a, count(*) AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT round(sum(a) / sum(b), 4) AS ratio, max(b) - min(b) AS spread, count(*) FILTER (WHERE a / b > 240000) AS rich FROM s""")
def p2(spark, d) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    sums = {"a": lambda df: F.sum("o_totalprice"), "b": lambda df: F.count("*")}
    named = {"ratio": lambda df: F.round(F.sum("a") / F.sum("b"), 4), "spread": lambda df: F.max("b") - F.min("b"), "rich": lambda df: F.count_if(F.col("a") / F.col("b") > 240000)}
    return summaries.over_clusters(rows, lambda df: df["c_nationkey"], sums, named)


@R.add("p3_metric_selectors", "SELECT 'price' AS metric, round(avg(o_totalprice), 4) AS mean, count(o_totalprice) AS n FROM orders UNION ALL SELECT 'finished', round(avg((o_orderstatus = 'F')::INTEGER), 4), count(*) FROM orders UNION ALL SELECT 'large only', round(avg(o_totalprice), 4), count(*) FROM orders WHERE o_totalprice > 300000")
def p3(spark, d) -> DataFrame:
    price = F.col("o_totalprice")
    selectors = {"price": lambda df: df["o_totalprice"], "finished": lambda df: (df["o_orderstatus"] == "F").cast("double"), "large only": lambda df: F.when(price > 300000, price)}
    return summaries.metrics(table(spark, d, "orders"), selectors).select("metric", F.round("mean", 4).alias("mean"), "n")


@R.add("p9_cheapest_level_that_passes", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity <= 10 THEN 'off' WHEN l_discount >= 0.05 AND l_quantity <= 30 THEN 'low' WHEN l_tax < 0.04 THEN 'medium' ELSE 'high' END AS level FROM lineitem")
def p9(spark, d) -> DataFrame:
    """A cascade of judges from the cheapest up; a later one is asked only where all before it failed."""
    judges = {"off": lambda df: df["l_quantity"] <= 10, "low": lambda df: (df["l_discount"] >= 0.05) & (df["l_quantity"] <= 30), "medium": lambda df: df["l_tax"] < 0.04}
    l = table(spark, d, "lineitem")
    return l.select("l_orderkey", "l_linenumber", summaries.cascade(l, judges, "high").alias("level"))


@R.add("p10_rows_from_decisions", "SELECT o_orderkey, unnest(['status', 'priority'] || CASE WHEN o_totalprice > 200000 THEN ['price'] ELSE [] END) AS question, unnest([o_orderstatus, o_orderpriority] || CASE WHEN o_totalprice > 200000 THEN ['high'] ELSE [] END) AS label FROM orders")
def p10(spark, d) -> DataFrame:
    """One decision gives two or three rows."""
    row = lambda q, c: F.struct(F.lit(q).alias("question"), c.alias("label"))
    rows = F.array(row("status", F.col("o_orderstatus")), row("priority", F.col("o_orderpriority")), F.when(F.col("o_totalprice") > 200000, row("price", F.lit("high"))))
    return table(spark, d, "orders").select("o_orderkey", F.inline(F.array_compact(rows)))


@R.add("p11_session_labeler", """
WITH o AS (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN event_type = before THEN 'repeat' WHEN event_type = 'error' AND after = 'error' THEN 'stuck' WHEN after IS NULL THEN 'last' ELSE 'step' END AS label FROM o""")
def p11(spark, d) -> DataFrame:
    """A stateful labeler over one session at a time."""

    def label(session: pd.DataFrame) -> pd.DataFrame:
        s = session.sort_values(["ts", "event_id"])
        kinds, out = s["event_type"].tolist(), []
        for i, kind in enumerate(kinds):
            after = kinds[i + 1] if i + 1 < len(kinds) else None
            out.append("repeat" if i and kinds[i - 1] == kind else "stuck" if kind == "error" and after == "error" else "last" if after is None else "step")
        return pd.DataFrame({"event_id": s["event_id"], "label": out})

    return table(spark, d, "events").select("user_id", "event_id", "event_type", "ts").groupBy("user_id").applyInPandas(label, "event_id long, label string")
