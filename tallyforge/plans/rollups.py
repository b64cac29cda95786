"""Log roll-ups: sums by day and key with totals, buckets, histograms, quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators.quantiles import quantiles, with_quantiles
from ..sources.tables import table
from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


def day(c: str = "ts") -> F.Column:
    return F.date_format(c, "yyyy-MM-dd")


@R.add("a1_usage_rollup", """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS value_sum, count(DISTINCT user_id) AS users
FROM events GROUP BY ROLLUP (strftime(ts, '%Y-%m-%d'), event_type)""")
def a1(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(day().alias("day"), "event_type", "value", "user_id")
    return e.rollup("day", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value_sum"), F.countDistinct("user_id").alias("users"))


@R.add("a2_cost_grouping_sets", """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, round(sum(value), 4) AS cost, grouping(strftime(ts, '%Y-%m-%d'), event_type) AS level
FROM events GROUP BY GROUPING SETS ((strftime(ts, '%Y-%m-%d'), event_type), (strftime(ts, '%Y-%m-%d')), (event_type), ())""")
def a2(spark, d) -> DataFrame:
    e = table(spark, d, "events").select(day().alias("day"), "event_type", "value")
    out = e.groupingSets([["day", "event_type"], ["day"], ["event_type"], []], "day", "event_type")
    return out.agg(F.round(F.sum("value"), 4).alias("cost"), F.grouping_id().cast("long").alias("level"))


@R.add("a3_usage_by_key_with_bucket", """
SELECT CASE WHEN event_type IN ('signup', 'error') THEN 'Tools/summaries' ELSE event_type END AS key, count(*) AS n, round(sum(value), 4) AS cost
FROM events GROUP BY 1 HAVING sum(value) <> 0""")
def a3(spark, d) -> DataFrame:
    key = F.when(F.col("event_type").isin("signup", "error"), "Tools/summaries").otherwise(F.col("event_type"))
    out = table(spark, d, "events").groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.sum("value").alias("cost"))
    return out.where("cost <> 0").orderBy(F.desc("cost"), "key").select("key", "n", F.round("cost", 4).alias("cost"))


@R.add("a4_merge_usage_records", """
SELECT user_id, round(sum(CASE WHEN event_type = 'purchase' THEN value END), 4) AS spent, round(sum(value), 4) AS total FROM events GROUP BY user_id""")
def a4(spark, d) -> DataFrame:
    """Partial sums per day merged per user: null only where both sides are null."""
    e = table(spark, d, "events")
    part = e.groupBy("user_id", day().alias("day")).agg(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("spent"), F.sum("value").alias("total"))
    return part.groupBy("user_id").agg(F.round(F.sum("spent"), 4).alias("spent"), F.round(F.sum("total"), 4).alias("total"))


@R.add("a5_per_tool_counts", """
SELECT event_type AS tool, count(*) AS calls, count(*) FILTER (WHERE value > 20) AS results, count(*) FILTER (WHERE value > 50) AS errors, CAST(sum(ceil(length(props) / 4.0)) AS BIGINT) AS tokens
FROM events GROUP BY 1""")
def a5(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy(F.col("event_type").alias("tool")).agg(
        F.count("*").alias("calls"), F.count_if(F.col("value") > 20).alias("results"), F.count_if(F.col("value") > 50).alias("errors"), F.sum(F.ceil(F.length("props") / 4)).cast("long").alias("tokens")
    )


BOUNDS = [10.0, 20.0, 30.0, 40.0, 1000.0]


@R.add("a6_histogram_with_empty_buckets", """
WITH b(bucket, lo, hi) AS (VALUES (0, -1e9, 10.0), (1, 10.0, 20.0), (2, 20.0, 30.0), (3, 30.0, 40.0), (4, 40.0, 1000.0), (5, 1000.0, 1e18))
SELECT b.bucket, count(l_quantity) AS n FROM b LEFT JOIN lineitem ON l_quantity > lo AND l_quantity <= hi GROUP BY 1""")
def a6(spark, d) -> DataFrame:
    got = table(spark, d, "lineitem").groupBy(stats.bucket(F.col("l_quantity"), BOUNDS).alias("bucket")).count()
    return spark.range(len(BOUNDS) + 1).select(F.col("id").cast("int").alias("bucket")).join(got, "bucket", "left").select("bucket", F.coalesce("count", F.lit(0)).alias("n"))


@R.add("a7_group_counts", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n FROM lineitem GROUP BY 1, 2")
def a7(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("n"))


@R.add("a8_group_summary", """
SELECT o_orderpriority AS key, count(*) AS calls, count(*) FILTER (WHERE o_orderstatus <> 'P') AS resolved, count(*) FILTER (WHERE o_orderstatus = 'F') AS success,
  count(*) FILTER (WHERE o_orderstatus = 'O') AS failed, count(*) FILTER (WHERE o_orderstatus = 'P') AS unresolved,
  round(count(*) FILTER (WHERE o_orderstatus = 'O') / count(*) FILTER (WHERE o_orderstatus <> 'P'), 8) AS fail_rate,
  round(median(o_totalprice), 4) AS med, round(quantile_cont(o_totalprice, 0.95), 4) AS p95 FROM orders GROUP BY 1""")
def a8(spark, d) -> DataFrame:
    st = F.col("o_orderstatus")
    o = table(spark, d, "orders").withColumnRenamed("o_orderpriority", "key")
    g = o.groupBy("key").agg(
        F.count("*").alias("calls"), F.count_if(st != "P").alias("resolved"), F.count_if(st == "F").alias("success"), F.count_if(st == "O").alias("failed"), F.count_if(st == "P").alias("unresolved"),
        F.round(stats.ratio(F.count_if(st == "O"), F.count_if(st != "P")), 8).alias("fail_rate"),
    )
    g = with_quantiles(g, o, ["key"], "o_totalprice", {"med": ("cont", 0.5), "p95": ("cont", 0.95)})
    return g.withColumn("med", F.round("med", 4)).withColumn("p95", F.round("p95", 4))


@R.add("a9_same_key_clusters", """
WITH c AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT count(*) FILTER (WHERE n >= 2) AS clusters, CAST(sum(n) FILTER (WHERE n >= 2) AS BIGINT) AS members, round(count(*) FILTER (WHERE n >= 2) / count(*), 8) AS share FROM c""")
def a9(spark, d) -> DataFrame:
    c = table(spark, d, "events").groupBy("user_id", day().alias("day"), "event_type").agg(F.count("*").alias("n"))
    big = F.count_if(F.col("n") >= 2)
    return c.agg(big.alias("clusters"), F.sum(F.when(F.col("n") >= 2, F.col("n"))).alias("members"), F.round(stats.ratio(big, F.count("*")), 8).alias("share"))


@R.add("a10_ratio_bands", """
SELECT CASE WHEN l_quantity = 25 THEN 'none' WHEN l_discount / l_tax IS NULL OR l_tax = 0 THEN 'none' WHEN l_discount / l_tax <= 0.5 THEN 'a' WHEN l_discount / l_tax <= 1 THEN 'b' WHEN l_discount / l_tax <= 2 THEN 'c' ELSE 'd' END AS band,
  count(*) AS n, round(avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END), 8) AS fail_rate FROM lineitem GROUP BY 1""")
def a10(spark, d) -> DataFrame:
    r = F.when(F.col("l_quantity") != 25, stats.ratio(F.col("l_discount"), F.col("l_tax")))
    band = F.when(r.isNull(), "none").when(r <= 0.5, "a").when(r <= 1, "b").when(r <= 2, "c").otherwise("d")
    return table(spark, d, "lineitem").groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("l_returnflag") == "R").cast("double")), 8).alias("fail_rate"))


@R.add("a11_counts_above_thresholds", """
SELECT count(*) FILTER (WHERE n_chars > 1024) AS over_1k, count(*) FILTER (WHERE n_chars > 4096) AS over_4k, count(*) FILTER (WHERE n_chars > 16384) AS over_16k, count(*) FILTER (WHERE n_chars > 65536) AS over_64k FROM documents""")
def a11(spark, d) -> DataFrame:
    return table(spark, d, "documents").agg(*[F.count_if(F.col("n_chars") > k * 1024).alias(f"over_{k}k") for k in (1, 4, 16, 64)])


@R.add("a12_linear_quantiles", """
SELECT l_shipmode AS flag, round(quantile_cont(x, 0.5), 4) AS p50, round(quantile_cont(x, 0.9), 4) AS p90, round(quantile_cont(x, 0.95), 4) AS p95, round(quantile_cont(x, 0.99), 4) AS p99
FROM (SELECT l_returnflag AS l_shipmode, l_extendedprice AS x FROM lineitem) GROUP BY 1""")
def a12(spark, d) -> DataFrame:
    qs = (0.5, 0.9, 0.95, 0.99)
    p = quantiles(table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "flag"), ["flag"], "l_extendedprice", {f"p{int(q * 100)}": ("cont", q) for q in qs})
    return p.select("flag", *[F.round(c, 4).alias(c) for c in p.columns[1:]])


@R.add("a13_median_of_session_rates", """
WITH s AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) AS rate FROM events GROUP BY 1, 2)
SELECT day, count(*) AS sessions, round(median(rate), 8) AS rate FROM s GROUP BY 1""")
def a13(spark, d) -> DataFrame:
    s = table(spark, d, "events").groupBy(day().alias("day"), "user_id").agg(F.avg((F.col("event_type") == "error").cast("double")).alias("rate"))
    g = with_quantiles(s.groupBy("day").agg(F.count("*").alias("sessions")), s, ["day"], "rate", {"mid": ("cont", 0.5)})
    return g.select("day", "sessions", F.round("mid", 8).alias("rate"))


@R.add("a14_time_buckets", """
SELECT strftime(ts, '%Y-%m-%d') AS day, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY ALL""")
def a14(spark, d) -> DataFrame:
    week = F.date_format(F.date_trunc("week", "ts"), "yyyy-MM-dd")
    return table(spark, d, "events").groupBy(day().alias("day"), week.alias("week"), F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))


@R.add("a15_session_stats_before_reset", """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, min(i) AS first FROM o WHERE event_type = 'signup' GROUP BY 1)
SELECT o.user_id, max(value) AS most, max(value) >= 40 AS over_80, max(value) >= 50 AS over_100, arg_max(value, i) FILTER (WHERE first IS NULL OR i < first) AS last_before
FROM o LEFT JOIN f USING (user_id) GROUP BY 1""")
def a15(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id")
    o = table(spark, d, "events").withColumn("i", F.row_number().over(w.orderBy("ts", "event_id")))
    o = o.withColumn("first", F.min(F.when(F.col("event_type") == "signup", F.col("i"))).over(w))
    before = F.when(F.col("first").isNull() | (F.col("i") < F.col("first")), F.col("i"))
    return o.groupBy("user_id").agg(
        F.max("value").alias("most"), (F.max("value") >= 40).alias("over_80"), (F.max("value") >= 50).alias("over_100"), F.max_by("value", before).alias("last_before")
    )


@R.add("a16_session_group_averages", """
SELECT c_mktsegment AS grp, round(avg(CASE WHEN c_acctbal > 0 THEN c_acctbal END), 6) AS mean_pos, round(median(CASE WHEN c_acctbal > 0 THEN c_acctbal END), 6) AS median_pos, count(*) AS n FROM customer GROUP BY 1""")
def a16(spark, d) -> DataFrame:
    x = F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("grp"), x.alias("x"))
    g = with_quantiles(c.groupBy("grp").agg(F.round(F.avg("x"), 6).alias("mean_pos"), F.count("*").alias("n")), c, ["grp"], "x", {"mid": ("cont", 0.5)})
    return g.select("grp", "mean_pos", F.round("mid", 6).alias("median_pos"), "n")


@R.add("a18_fieldwise_sum", """
SELECT c_nationkey AS nation, count(*) AS n, round(sum(c_acctbal), 4) AS balance, array_to_string(list_sort(list(c_custkey)), ',') AS keys FROM customer GROUP BY 1""")
def a18(spark, d) -> DataFrame:
    part = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.sum("c_acctbal").alias("balance"), F.collect_list("c_custkey").alias("keys"))
    keys = F.array_join(F.sort_array(F.flatten(F.collect_list("keys"))).cast("array<string>"), ",")
    return part.groupBy(F.col("c_nationkey").alias("nation")).agg(F.sum("n").alias("n"), F.round(F.sum("balance"), 4).alias("balance"), keys.alias("keys"))


@R.add("a32_label_shares", """
SELECT lang AS kind, source AS label, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 8) AS share FROM documents GROUP BY 1, 2""")
def a32(spark, d) -> DataFrame:
    c = table(spark, d, "documents").groupBy(F.col("lang").alias("kind"), F.col("source").alias("label")).agg(F.count("*").alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("kind")), 8)).orderBy("kind", F.desc("n"), "label")


@R.add("a33_length_distribution", """
SELECT lang, min(n_chars) AS least, quantile_disc(n_chars, 0.5) AS med, quantile_disc(n_chars, 0.9) AS p90, quantile_disc(n_chars, 0.99) AS p99, max(n_chars) AS most, round(avg(n_chars), 6) AS mean,
  round(avg(CASE WHEN n_chars > 4096 THEN 1.0 ELSE 0 END), 8) AS over_limit, list_sort(list(n_chars))[1 + least(count(*) - 1, CAST(floor(0.95 * count(*)) AS BIGINT))] AS p95_floor FROM documents GROUP BY 1""")
def a33(spark, d) -> DataFrame:
    x, t = F.col("n_chars"), table(spark, d, "documents").select("lang", "n_chars")
    g = t.groupBy("lang").agg(F.min(x).alias("least"), F.max(x).alias("most"), F.round(F.avg(x), 6).alias("mean"), F.round(F.avg((x > 4096).cast("double")), 8).alias("over_limit"))
    return with_quantiles(g, t, ["lang"], "n_chars", {"med": ("disc", 0.5), "p90": ("disc", 0.9), "p99": ("disc", 0.99), "p95_floor": ("floor", 0.95)})


@R.add("a34_class_table", """
SELECT event_type AS class, count(*) AS turns, round(count(*) / sum(count(*)) OVER (), 8) AS turn_share, round(sum(value) / sum(sum(value)) OVER (), 8) AS time_share, round(avg(value), 6) AS mean FROM events GROUP BY 1""")
def a34(spark, d) -> DataFrame:
    every = Window.partitionBy()
    c = table(spark, d, "events").groupBy(F.col("event_type").alias("class")).agg(F.count("*").alias("turns"), F.sum("value").alias("time"))
    return c.select("class", "turns", F.round(F.col("turns") / F.sum("turns").over(every), 8).alias("turn_share"), F.round(F.col("time") / F.sum("time").over(every), 8).alias("time_share"), F.round(F.col("time") / F.col("turns"), 6).alias("mean"))


@R.add("a35_contingency", """
SELECT o_orderpriority AS variant, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY 1""")
def a35(spark, d) -> DataFrame:
    c = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("variant")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return c.select("variant", *[F.coalesce(x, F.lit(0)).cast("long").alias(x.lower()) for x in ("F", "O", "P")])


@R.add("a36_most_common", "SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, brand LIMIT 7")
def a36(spark, d) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "brand").limit(7)


@R.add("a37_best_run_per_key", """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) = 1""")
def a37(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    best = F.max(F.struct("o_totalprice", "o_orderkey"))
    return o.groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.o_orderkey", "b.o_totalprice")


@R.add("a38_latest_per_key", """
SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def a38(spark, d) -> DataFrame:
    last = F.max(F.struct("o_orderdate", "o_orderkey"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(last.alias("b")).select("o_custkey", "b.o_orderkey", day("b.o_orderdate").alias("day"))


@R.add("a40_ratio_of_sums_and_median_of_ratios", """
SELECT l_returnflag AS flag, round(sum(l_extendedprice) / sum(l_quantity), 6) AS of_sums, round(median(l_extendedprice / l_quantity), 6) AS of_ratios FROM lineitem GROUP BY 1""")
def a40(spark, d) -> DataFrame:
    a, b = F.col("l_extendedprice"), F.col("l_quantity")
    t = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), a.alias("a"), b.alias("b"), (a / b).alias("r"))
    g = with_quantiles(t.groupBy("flag").agg(F.round(F.sum("a") / F.sum("b"), 6).alias("of_sums")), t, ["flag"], "r", {"mid": ("cont", 0.5)})
    return g.select("flag", "of_sums", F.round("mid", 6).alias("of_ratios"))


@R.add("a41_shared_unit_size", """
SELECT l_suppkey, round(sum(p_retailprice), 4) AS size FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1""")
def a41(spark, d) -> DataFrame:
    units = table(spark, d, "lineitem").select("l_suppkey", F.col("l_partkey").alias("p_partkey")).distinct()
    return units.join(table(spark, d, "part"), "p_partkey").groupBy("l_suppkey").agg(F.round(F.sum("p_retailprice"), 4).alias("size"))


@R.add("a42_ratio_imputation", """
WITH r AS (SELECT sum(value) FILTER (WHERE event_type <> 'view') / sum(CAST(json_extract(props, '$.k') AS DOUBLE)) FILTER (WHERE event_type <> 'view') AS r FROM events)
SELECT event_id, round(CASE WHEN event_type = 'view' THEN r * CAST(json_extract(props, '$.k') AS DOUBLE) ELSE value END, 6) AS value FROM events, r""")
def a42(spark, d) -> DataFrame:
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    known = F.when(F.col("event_type") != "view", F.lit(True))
    r = e.agg((F.sum(F.when(known, F.col("value"))) / F.sum(F.when(known, F.col("k")))).alias("r"))  # one row
    out = e.crossJoin(F.broadcast(r))
    return out.select("event_id", F.round(F.when(F.col("event_type") == "view", F.col("r") * F.col("k")).otherwise(F.col("value")), 6).alias("value"))


@R.add("a44_within_group_slope", """
WITH c AS (SELECT l_returnflag AS g, l_quantity - avg(l_quantity) OVER (PARTITION BY l_orderkey) AS dx, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_orderkey) AS dy FROM lineitem)
SELECT round(sum(dx * dy) / sum(dx * dx), 4) AS slope, (SELECT round(regr_slope(l_extendedprice, l_quantity), 4) FROM lineitem) AS plain FROM c""")
def a44(spark, d) -> DataFrame:
    w = Window.partitionBy("l_orderkey")
    c = table(spark, d, "lineitem").select("l_quantity", "l_extendedprice", (F.col("l_quantity") - F.avg("l_quantity").over(w)).alias("dx"), (F.col("l_extendedprice") - F.avg("l_extendedprice").over(w)).alias("dy"))
    return c.agg(F.round(F.sum(F.col("dx") * F.col("dy")) / F.sum(F.col("dx") * F.col("dx")), 4).alias("slope"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 4).alias("plain"))


@R.add("a45_span_durations", """
SELECT event_type AS name, count(*) AS spans, round(sum(dur), 3) AS seconds FROM (
  SELECT event_type, date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) / 1e6 AS dur FROM events) WHERE dur IS NOT NULL GROUP BY 1""")
def a45(spark, d) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_type", ((us - F.lag(us).over(w)) / 1e6).alias("dur"))
    return e.where("dur is not null").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("spans"), F.round(F.sum("dur"), 3).alias("seconds"))


@R.add("a50_part_coverage", """
WITH t AS (SELECT l_orderkey, bool_and(l_quantity > 5) AS covered, bool_or(l_quantity > 45) AS any_big FROM lineitem GROUP BY 1)
SELECT count(*) AS turns, round(avg(CASE WHEN covered THEN 1.0 ELSE 0 END), 8) AS covered, round(avg(CASE WHEN any_big THEN 1.0 ELSE 0 END), 8) AS any_big FROM t""")
def a50(spark, d) -> DataFrame:
    t = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_quantity") > 5).alias("covered"), F.bool_or(F.col("l_quantity") > 45).alias("any_big"))
    return t.agg(F.count("*").alias("turns"), F.round(F.avg(F.col("covered").cast("double")), 8).alias("covered"), F.round(F.avg(F.col("any_big").cast("double")), 8).alias("any_big"))


# top-k and sorts


@R.add("k1_top_by_difference", """
SELECT l_orderkey, l_linenumber, l_extendedprice - l_quantity * 1000 AS diff FROM lineitem ORDER BY abs(diff) DESC, l_orderkey, l_linenumber LIMIT 10""")
def k1(spark, d) -> DataFrame:
    diff = F.col("l_extendedprice") - F.col("l_quantity") * 1000
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", diff.alias("diff")).orderBy(F.abs("diff").desc(), "l_orderkey", "l_linenumber").limit(10)


@R.add("k2_worst_examples", """
SELECT l_orderkey, l_linenumber, round(l_discount / nullif(l_tax, 0), 6) AS ratio, l_extendedprice FROM lineitem
ORDER BY l_discount / nullif(l_tax, 0) DESC NULLS FIRST, l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20""")
def k2(spark, d) -> DataFrame:
    r = F.try_divide("l_discount", "l_tax")
    o = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r.alias("r"), "l_extendedprice")
    return o.orderBy(F.desc_nulls_first("r"), F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(20).select("l_orderkey", "l_linenumber", F.round("r", 6).alias("ratio"), "l_extendedprice")


@R.add("k3_top_n_per_group", """
SELECT c_mktsegment, c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 5000 QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) <= 5""")
def k3(spark, d) -> DataFrame:
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    c = table(spark, d, "customer").where("c_acctbal >= 5000").select("c_mktsegment", "c_custkey", "c_acctbal")
    return c.withColumn("r", F.row_number().over(w)).where("r <= 5").drop("r")


@R.add("k4_keyset_page", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 26")
def k4(spark, d) -> DataFrame:
    """A page after a cursor, with one row more to tell whether another follows."""
    return table(spark, d, "orders").where("o_orderkey > 100 and o_orderstatus = 'F'").orderBy("o_orderkey").limit(26).select("o_orderkey", "o_custkey")


@R.add("k6_hash_order", "SELECT c_custkey, sha256('7:' || c_name) AS h FROM customer ORDER BY h LIMIT 25")
def k6(spark, d) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.sha2(F.concat(F.lit("7:"), "c_name").cast("binary"), 256).alias("h")).orderBy("h").limit(25)


@R.add("k8_first_argmax", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= l_discount * 500 AND l_quantity >= l_tax * 500 THEN 0 WHEN l_discount * 500 >= l_tax * 500 THEN 1 ELSE 2 END AS choice FROM lineitem")
def k8(spark, d) -> DataFrame:
    p = F.array("l_quantity", F.col("l_discount") * 500, F.col("l_tax") * 500)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("choice"))


@R.add("k9_best_under_constraint", """
SELECT c_mktsegment, arg_max(c_custkey, (c_acctbal, c_custkey)) AS c_custkey FROM customer WHERE c_acctbal <= 7000 GROUP BY 1""")
def k9(spark, d) -> DataFrame:
    return table(spark, d, "customer").where("c_acctbal <= 7000").groupBy("c_mktsegment").agg(F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("c_custkey"))


@R.add("k11_pages_of_ten", """
WITH r AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)
SELECT c_nationkey, CAST((i - 1) // 10 + 1 AS INTEGER) AS page, count(*) AS items, max(n) > max(i) AS more FROM r WHERE i <= 30 GROUP BY 1, 2""")
def k11(spark, d) -> DataFrame:
    w = Window.partitionBy("c_nationkey")
    r = table(spark, d, "customer").select("c_nationkey", F.row_number().over(w.orderBy("c_custkey")).alias("i"), F.count("*").over(w).alias("n")).where("i <= 30")
    return r.groupBy("c_nationkey", (F.floor((F.col("i") - 1) / 10) + 1).cast("int").alias("page")).agg(F.count("*").alias("items"), (F.max("n") > F.max("i")).alias("more"))


# set operations


@R.add("u1_union_one_owner", """
SELECT key, count(*) AS n FROM (SELECT c_nationkey AS key FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 1""")
def u1(spark, d) -> DataFrame:
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("key")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("key"))
    return a.unionByName(b).groupBy("key").agg(F.count("*").alias("n"))


@R.add("u2_repeat_rows", "SELECT r_name || '#' || i AS id FROM region, range(3) t(i)")
def u2(spark, d) -> DataFrame:
    copies = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")
    return table(spark, d, "region").select("r_name", copies).select(F.concat("r_name", F.lit("#"), F.col("i").cast("string")).alias("id"))


@R.add("u3_intersection", "SELECT p_partkey AS key FROM part INTERSECT SELECT l_partkey FROM lineitem")
def u3(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("key")).intersect(table(spark, d, "lineitem").select(F.col("l_partkey").alias("key")))


@R.add("u4_difference", "SELECT c_custkey AS key FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def u4(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key")).subtract(table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("key")))


@R.add("u6_multiset_intersection", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def u6(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).intersectAll(o.where("o_orderstatus = 'O'").select("o_custkey"))


@R.add("u7_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def u7(spark, d) -> DataFrame:
    return table(spark, d, "part").select("p_brand", "p_type").dropDuplicates()
