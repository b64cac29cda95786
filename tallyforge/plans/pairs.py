"""Filters, joins and paired-experiment statistics on the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import pairing
from ..operators.quantiles import quantiles, with_quantiles
from ..sources.tables import table
from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


@R.add("f1_filter_kind", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' AND value IS NOT NULL")
def f1(spark, d) -> DataFrame:
    return table(spark, d, "events").where("event_type = 'purchase' and value is not null").select("event_id", "user_id", "value")


@R.add("f2_half_open_window", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def f2(spark, d) -> DataFrame:
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    return table(spark, d, "events").where((F.col("ts") >= t("2024-01-05")) & (F.col("ts") < t("2024-01-12"))).select("event_id")


@R.add("f3_record_filters", "SELECT p_partkey FROM part WHERE contains(lower(p_name), lower('RED')) AND p_type = 'ECONOMY'")
def f3(spark, d) -> DataFrame:
    return table(spark, d, "part").where(F.contains(F.lower("p_name"), F.lower(F.lit("RED"))) & (F.col("p_type") == "ECONOMY")).select("p_partkey")


@R.add("f4_explode_blocks", """
SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, block FROM (
  SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS block, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM conversations) WHERE block <> ''""")
def f4(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "block")).where("block <> ''")


@R.add("f5_content_to_text", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1")
def f5(spark, d) -> DataFrame:
    lines = F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"))


@R.add("f6_defaults", "SELECT doc_id, coalesce(toxic, 0) AS toxic, coalesce(CAST(quality AS VARCHAR), 'unknown') AS quality FROM documents LEFT JOIN labels USING (doc_id)")
def f6(spark, d) -> DataFrame:
    out = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("toxic", F.lit(0)).alias("toxic"), F.coalesce(F.col("quality").cast("string"), F.lit("unknown")).alias("quality"))


def scan(df: DataFrame, filters: dict, key: str, after=None, limit: int | None = None, newest_first: bool = False) -> DataFrame:
    """Filtered scan with a cursor: conditions that are None are left out."""
    for c, v in filters.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    if after is not None:
        df = df.where(F.col(key) < after if newest_first else F.col(key) > after)
    if limit is None:
        return df
    return df.orderBy(F.desc(key) if newest_first else F.asc(key)).limit(limit + 1)


@R.add("f7_optional_conjunctive_filters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' ORDER BY o_orderkey DESC LIMIT 11")
def f7(spark, d) -> DataFrame:
    return scan(table(spark, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": "2-HIGH", "o_custkey": None}, "o_orderkey", None, 10, True).select("o_orderkey")


@R.add("f8_inclusive_range", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN 200 AND 400")
def f8(spark, d) -> DataFrame:
    return table(spark, d, "orders").where(F.col("o_orderkey").between(200, 400)).select("o_orderkey", "o_custkey")


@R.add("f10_case_ladder", """
SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]{3}\\.[0-9]+\\.[0-9]+\\.[0-9]+') THEN 'address' WHEN contains(text, '@') THEN 'mail' WHEN contains(text, 'License') THEN 'license' WHEN contains(text, '|') THEN 'table' ELSE 'prose' END AS kind FROM documents""".replace("\\\\", "\\"))
def f10(spark, d) -> DataFrame:
    t = F.col("text")
    kind = F.when(F.rlike(t, F.lit(r"[0-9]{3}\.[0-9]+\.[0-9]+\.[0-9]+")), "address").when(t.contains("@"), "mail").when(t.contains("License"), "license").when(t.contains("|"), "table").otherwise("prose")
    return table(spark, d, "documents").select("doc_id", kind.alias("kind"))


@R.add("f11_left_out_by_reason", """
SELECT CASE WHEN o_orderstatus = 'P' THEN 'unfinished' WHEN o_totalprice < 5000 THEN 'small' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unranked' ELSE 'used' END AS reason, count(*) AS n FROM orders GROUP BY 1""")
def f11(spark, d) -> DataFrame:
    reason = F.when(F.col("o_orderstatus") == "P", "unfinished").when(F.col("o_totalprice") < 5000, "small").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "unranked").otherwise("used")
    return table(spark, d, "orders").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@R.add("f12_whole_block_exclusion", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey IS NOT NULL)")
def f12(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.join(o.where("o_orderstatus = 'P'").select("o_custkey").distinct(), "o_custkey", "left_anti").select("o_orderkey")


@R.add("f13_integrity_violations", """
SELECT 'negative price' AS rule, count(*) AS n FROM orders WHERE o_totalprice < 0 UNION ALL SELECT 'repeated key', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'no customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'urgent', count(*) FROM orders WHERE o_orderpriority = '1-URGENT'""")
def f13(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    count = lambda rule, df: df.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n")
    lost = o.join(table(spark, d, "customer"), o["o_custkey"] == F.col("c_custkey"), "left_anti")
    parts = [count("negative price", o.where("o_totalprice < 0")), count("repeated key", o.groupBy("o_orderkey").count().where("count > 1")), count("no customer", lost), count("urgent", o.where("o_orderpriority = '1-URGENT'"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@R.add("f14_range_checks", "SELECT count(*) FILTER (WHERE l_discount NOT BETWEEN 0 AND 1) AS bad_discount, count(*) FILTER (WHERE l_quantity < 0) AS bad_quantity, count(*) AS n FROM lineitem")
def f14(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.count_if(~F.col("l_discount").between(0, 1)).alias("bad_discount"), F.count_if(F.col("l_quantity") < 0).alias("bad_quantity"), F.count("*").alias("n"))


@R.add("f16_read_mode", "SELECT CASE WHEN json_extract(props, '$.k') > 50 OR value < 10 THEN 'partial' ELSE 'full' END AS mode, count(*) AS n FROM events GROUP BY 1")
def f16(spark, d) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").groupBy(F.when((k > 50) | (F.col("value") < 10), "partial").otherwise("full").alias("mode")).agg(F.count("*").alias("n"))


@R.add("f17_tiered_cost", """
WITH rate(lo, r) AS (VALUES (0.0, 1.0), (10.0, 0.9), (25.0, 0.75), (40.0, 0.5))
SELECT l_orderkey, l_linenumber, round(l_extendedprice * (SELECT arg_max(r, lo) FROM rate WHERE lo <= l_quantity), 4) AS cost FROM lineitem""")
def f17(spark, d) -> DataFrame:
    """Each line at the rate of the highest tier at or below its quantity."""
    tiers = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(r).alias("r")) for lo, r in ((0.0, 1.0), (10.0, 0.9), (25.0, 0.75), (40.0, 0.5))])
    rate = F.array_max(F.filter(tiers, lambda t: t["lo"] <= F.col("l_quantity")))["r"]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") * rate, 4).alias("cost"))


@R.add("j1_call_to_result_full_outer", """
WITH c AS (SELECT conv_id, turn FROM conversations WHERE role = 'user'), r AS (SELECT conv_id, turn - 1 AS turn, length(text) AS size FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, size, CASE WHEN c.conv_id IS NULL THEN 'unmatched result' WHEN r.conv_id IS NULL THEN 'unresolved call' ELSE 'resolved' END AS state
FROM (SELECT *, conv_id AS x FROM c) c FULL JOIN (SELECT *, conv_id AS y FROM r) r USING (conv_id, turn)""".replace("c.conv_id IS NULL", "x IS NULL").replace("r.conv_id IS NULL", "y IS NULL"))
def j1(spark, d) -> DataFrame:
    t = table(spark, d, "conversations")
    c = t.where("role = 'user'").select("conv_id", "turn", F.lit(True).alias("x"))
    r = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("long").alias("size"), F.lit(True).alias("y"))
    state = F.when(F.col("x").isNull(), "unmatched result").when(F.col("y").isNull(), "unresolved call").otherwise("resolved")
    return c.join(r, ["conv_id", "turn"], "full").select("conv_id", "turn", "size", state.alias("state"))


@R.add("j2_call_to_result_left", "SELECT c.conv_id, c.turn, r.turn AS answered FROM conversations c LEFT JOIN conversations r ON c.conv_id = r.conv_id AND r.turn = c.turn + 1 AND r.role = 'assistant' WHERE c.role = 'user'")
def j2(spark, d) -> DataFrame:
    t = table(spark, d, "conversations")
    r = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("answered"))
    return t.where("role = 'user'").select("conv_id", "turn").join(r, ["conv_id", "turn"], "left")


@R.add("j3_result_attach", "SELECT o_custkey, count(*) AS orders, CAST(sum(n) AS BIGINT) AS lines FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def j3(spark, d) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return table(spark, d, "orders").join(n, "o_orderkey").groupBy("o_custkey").agg(F.count("*").alias("orders"), F.sum("n").alias("lines"))


def _sides(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    side = lambda p: o.where(F.col("o_orderpriority") == p).groupBy("o_custkey").agg(F.sum("o_totalprice").alias("cost"), (F.max("o_totalprice") > 250000).alias("passed"))
    return pairing.paired(side("1-URGENT"), side("5-LOW"), "o_custkey")


_SIDES = """
WITH s AS (SELECT o_custkey, o_orderpriority AS p, sum(o_totalprice) AS cost, max(o_totalprice) > 250000 AS passed FROM orders GROUP BY 1, 2),
a AS (SELECT * FROM s WHERE p = '1-URGENT'), b AS (SELECT * FROM s WHERE p = '5-LOW'),
j AS (SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, a.cost AS bc, b.cost AS ac, a.passed AS bp, b.passed AS ap,
  CASE WHEN a.o_custkey IS NOT NULL AND b.o_custkey IS NOT NULL THEN 'paired' WHEN b.o_custkey IS NULL THEN 'base_only' ELSE 'arm_only' END AS state FROM a FULL JOIN b ON a.o_custkey = b.o_custkey)
"""


@R.add("j4_block_pairing", _SIDES + "SELECT o_custkey, state, round(bc, 4) AS base_cost, round(ac, 4) AS arm_cost FROM j")
def j4(spark, d) -> DataFrame:
    return _sides(spark, d).select("o_custkey", "state", F.round("base_cost", 4).alias("base_cost"), F.round("arm_cost", 4).alias("arm_cost"))


@R.add("a23_paired_statistics", _SIDES + """, p AS (SELECT * FROM j WHERE state = 'paired'), t AS (
SELECT count(*) AS n, count(*) FILTER (WHERE bp) AS base_passed, count(*) FILTER (WHERE ap) AS arm_passed, count(*) FILTER (WHERE bp AND NOT ap) AS base_only, count(*) FILTER (WHERE ap AND NOT bp) AS arm_only,
  count(*) FILTER (WHERE ap AND bp) AS n_both, sum(bc) AS base_total, sum(ac) AS arm_total, avg(ln(ac / bc)) FILTER (WHERE ap AND bp) AS lr, median(ln(ac / bc)) FILTER (WHERE ap AND bp) AS mlr FROM p),
m AS (SELECT least(1.0, 2 * sum(exp(lgamma(base_only + arm_only + 1) - lgamma(k + 1) - lgamma(base_only + arm_only - k + 1) - (base_only + arm_only) * ln(2)))) AS p FROM t, range(100000) r(k) WHERE k <= least(base_only, arm_only))
SELECT n, base_passed, arm_passed, base_only, arm_only, n_both, round(base_total, 6) AS base_total, round(arm_total, 6) AS arm_total, round(arm_total / base_total, 6) AS total_ratio, round(exp(lr), 6) AS geo_ratio, round(exp(mlr), 6) AS median_ratio,
  round((arm_passed / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(arm_passed / n * (1 - arm_passed / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS arm_low,
  round((arm_passed / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(arm_passed / n * (1 - arm_passed / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS arm_high,
  round(p, 6) AS p, round((arm_passed - base_passed) / n, 6) AS pass_difference FROM t, m""")
def a23(spark, d) -> DataFrame:
    return pairing.paired_statistics(_sides(spark, d), "passed", "cost")


@R.add("a20_wilson_intervals", """
SELECT o_orderpriority AS arm, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS k,
  round((k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 8) AS low,
  round((k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 8) AS high FROM orders GROUP BY 1""")
def a20(spark, d) -> DataFrame:
    g = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("arm")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return g.select("arm", "n", "k", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


@R.add("a21_mcnemar", """
WITH t AS (SELECT c_nationkey AS g, CAST(c_nationkey % 7 AS BIGINT) AS b, CAST(max(c_custkey) % 9 AS BIGINT) AS c FROM customer GROUP BY 1)
SELECT g, b, c, round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT CAST(sum(factorial(CAST(b + c AS INTEGER)) // (factorial(CAST(k AS INTEGER)) * factorial(CAST(b + c - k AS INTEGER)))) AS DOUBLE) FROM range(20) r(k) WHERE k <= least(b, c)) / pow(2, b + c)) END, 9) AS p FROM t""")
def a21(spark, d) -> DataFrame:
    t = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("g")).agg(F.max("c_custkey").alias("m"))
    t = t.select("g", (F.col("g") % 7).cast("long").alias("b"), (F.col("m") % 9).cast("long").alias("c"))
    return t.withColumn("p", F.round(stats.mcnemar(F.col("b"), F.col("c")), 9))


@R.add("a22_geometric_mean", "SELECT o_orderpriority AS arm, round(exp(avg(ln(o_totalprice))), 4) AS geo, round(exp(median(ln(o_totalprice))), 4) AS mid FROM orders WHERE o_totalprice > 0 GROUP BY 1")
def a22(spark, d) -> DataFrame:
    o = table(spark, d, "orders").where("o_totalprice > 0")
    o = o.select(F.col("o_orderpriority").alias("arm"), "o_totalprice", F.log("o_totalprice").alias("l"))
    g = with_quantiles(o.groupBy("arm").agg(F.round(stats.geomean(F.col("o_totalprice")), 4).alias("geo")), o, ["arm"], "l", {"m": ("cont", 0.5)})
    return g.select("arm", "geo", F.round(F.exp("m"), 4).alias("mid"))


@R.add("a24_cluster_bootstrap", """
WITH s AS (SELECT c_nationkey AS c, sum(o_totalprice) AS a, count(*) AS b, row_number() OVER (ORDER BY c_nationkey) - 1 AS i, count(*) OVER () AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
d AS (SELECT rep, s.a, s.b FROM range(4000) r(rep), range(1000) t(slot), (SELECT max(n) AS n FROM s) m
  JOIN s ON s.i = CAST('0x' || substr(sha256('1:' || rep || ':' || slot), 1, 13) AS BIGINT) % m.n WHERE slot < m.n),
q AS (SELECT rep, sum(a) / sum(b) AS r FROM d GROUP BY 1)
SELECT round(quantile_cont(r, 0.025), 4) AS low, round(quantile_cont(r, 0.975), 4) AS high, count(*) AS replicates FROM q""")
def a24(spark, d) -> DataFrame:
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_totalprice", F.lit(1.0).alias("one"))
    out = pairing.cluster_bootstrap(rows, "c_nationkey", "o_totalprice", "one")
    return out.select(F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), "replicates")


@R.add("a25_relative_drop_gate", """
WITH m AS (SELECT c_mktsegment AS task, median(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT') AS a, median(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW') AS b FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT task, round((a - b) / a, 8) AS drop, CASE WHEN (a - b) / a > 0.01 THEN 'pass' WHEN a IS NULL OR b IS NULL THEN 'no data' ELSE 'fail' END AS verdict FROM m""")
def a25(spark, d) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    side = lambda p: F.when(F.col("o_orderpriority") == p, F.col("o_totalprice"))
    o = o.select(F.col("c_mktsegment").alias("task"), side("1-URGENT").alias("base"), side("5-LOW").alias("arm"))
    m = o.select("task").distinct()
    for name, c in (("a", "base"), ("b", "arm")):
        m = with_quantiles(m, o, ["task"], c, {name: ("cont", 0.5)})
    m = m.withColumn("x", (F.col("a") - F.col("b")) / F.col("a"))
    return m.select("task", F.round("x", 8).alias("drop"), F.when(F.col("x") > 0.01, "pass").when(F.col("x").isNull(), "no data").otherwise("fail").alias("verdict"))


@R.add("a26_arm_summary", """
SELECT o_orderpriority AS arm, c_mktsegment AS section, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0 END), 8) AS solved, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE) / count(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 4) AS cost FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def a26(spark, d) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    done = F.col("o_orderstatus") == "F"
    return o.groupBy(F.col("o_orderpriority").alias("arm"), F.col("c_mktsegment").alias("section")).agg(F.count("*").alias("n"), F.round(F.avg(done.cast("double")), 8).alias("solved"), F.round(F.try_divide(F.sum(F.when(done, F.col("o_totalprice").cast("decimal(18,2)"))).cast("double"), F.count(F.when(done, F.col("o_totalprice")))), 4).alias("cost"))


@R.add("a27_paired_metric_delta", _SIDES + "SELECT count(*) AS n, round(avg(bc), 4) AS control, round(avg(ac), 4) AS treatment, round(avg(ac) - avg(bc), 4) AS delta FROM j WHERE bc IS NOT NULL AND ac IS NOT NULL")
def a27(spark, d) -> DataFrame:
    p = _sides(spark, d).where("base_cost is not null and arm_cost is not null")
    return p.agg(F.count("*").alias("n"), F.round(F.avg("base_cost"), 4).alias("control"), F.round(F.avg("arm_cost"), 4).alias("treatment"), F.round(F.avg("arm_cost") - F.avg("base_cost"), 4).alias("delta"))


@R.add("a28_sum_with_availability", "SELECT lang, CAST(sum(quality) AS BIGINT) AS total, count(quality) AS available, count(*) AS runs FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def a28(spark, d) -> DataFrame:
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("lang").agg(F.sum("quality").alias("total"), F.count("quality").alias("available"), F.count("*").alias("runs"))


@R.add("a29_flaky_cases", """
SELECT o_custkey AS case_id, count(DISTINCT o_orderstatus) > 1 AS flaky, bool_and(o_orderstatus = 'F') AS saturated, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END) < 0 AS negative FROM orders GROUP BY 1""")
def a29(spark, d) -> DataFrame:
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg((F.countDistinct(s) > 1).alias("flaky"), F.bool_and(s == "F").alias("saturated"), (F.sum(F.when(s == "F", 1).otherwise(-1)) < 0).alias("negative"))


@R.add("a30_headline_when_complete", _SIDES + "SELECT count(*) FILTER (WHERE state <> 'paired') AS blocked, CASE WHEN bool_and(state = 'paired') THEN round(sum(ac) / sum(bc), 6) END AS headline, round(sum(ac) / sum(bc), 6) AS anyway FROM j")
def a30(spark, d) -> DataFrame:
    ok = F.bool_and(F.col("state") == "paired")
    ratio = F.round(F.sum("arm_cost") / F.sum("base_cost"), 6)
    return _sides(spark, d).agg(F.count_if(F.col("state") != "paired").alias("blocked"), F.when(ok, ratio).alias("headline"), ratio.alias("anyway"))


@R.add("j6_design_against_observations", """
WITH design AS (SELECT DISTINCT c_custkey, v FROM customer, (VALUES ('1-URGENT'), ('5-LOW')) x(v)),
o AS (SELECT design.c_custkey AS k, v, count(o_orderkey) AS runs FROM design LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = v GROUP BY 1, 2)
SELECT k, max(runs) FILTER (WHERE v = '1-URGENT') AS control, max(runs) FILTER (WHERE v = '5-LOW') AS treatment,
  concat_ws(',', CASE WHEN control = 0 THEN 'no control' END, CASE WHEN treatment = 0 THEN 'no treatment' END, CASE WHEN control <> treatment THEN 'uneven' END) AS reasons FROM o GROUP BY 1""")
def j6(spark, d) -> DataFrame:
    design = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    seen = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).count()
    j = design.join(seen, "k", "left").select("k", F.coalesce("1-URGENT", F.lit(0)).alias("control"), F.coalesce("5-LOW", F.lit(0)).alias("treatment"))
    reasons = F.concat_ws(",", F.when(F.col("control") == 0, "no control"), F.when(F.col("treatment") == 0, "no treatment"), F.when(F.col("control") != F.col("treatment"), "uneven"))
    return j.withColumn("reasons", reasons)


@R.add("j7_label_to_first_decision", "SELECT doc_id, min_by.first AS first_turn, quality FROM labels LEFT JOIN (SELECT conv_id, min(turn) AS first FROM conversations GROUP BY 1) min_by ON conv_id = doc_id")
def j7(spark, d) -> DataFrame:
    first = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.min("turn").alias("first_turn"))
    return table(spark, d, "labels").select("doc_id", "quality").join(first, "doc_id", "left")


@R.add("j8_positional_join", """
WITH a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'click'),
b AS (SELECT user_id, event_id AS reply, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE event_type = 'view')
SELECT a.user_id, a.event_id, b.reply FROM a JOIN b USING (user_id, i)""")
def j8(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    side = lambda kind, name: table(spark, d, "events").where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(name), F.row_number().over(w).alias("i"))
    return side("click", "event_id").join(side("view", "reply"), ["user_id", "i"]).drop("i")


@R.add("j9_first_n_of_each", "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 5")
def j9(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", F.row_number().over(w).alias("i")).where("i <= 5").select("event_id")


@R.add("j10_dimension_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def j10(spark, d) -> DataFrame:
    """Small dimensions; the planner broadcasts them by their file size."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name", "r_name")


@R.add("j13_name_containment_join", """
WITH a AS (SELECT DISTINCT lower(p_name) AS x FROM part), b AS (SELECT DISTINCT lower(p_type) AS y FROM part)
SELECT x, y FROM a, b WHERE x = y OR (least(length(x), length(y)) >= 5 AND (contains(x, y) OR contains(y, x)))""")
def j13(spark, d) -> DataFrame:
    """Distinct normalised names: containment found through shared substrings of the shorter length."""
    p = table(spark, d, "part")
    a, b = p.select(F.lower("p_name").alias("x")).distinct(), p.select(F.lower("p_type").alias("y")).distinct()
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 4, F.lit(1))), lambda i: F.substr(F.col(c), i, F.lit(5))))
    near = a.withColumn("g", F.explode(grams("x"))).join(b.withColumn("g", F.explode(grams("y"))), "g").select("x", "y").distinct()
    ok = (F.col("x") == F.col("y")) | ((F.least(F.length("x"), F.length("y")) >= 5) & (F.contains("x", F.col("y")) | F.contains("y", F.col("x"))))
    return near.where(ok)


@R.add("j14_semi_and_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS open FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)")
def j14(spark, d) -> DataFrame:
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey")
    c = c.join(o.where("o_totalprice > 480000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    has = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("x")).distinct()
    return c.join(has, "c_custkey", "left").select("c_custkey", F.coalesce("x", F.lit(False)).alias("open"))


@R.add("j15_as_of_join", """
WITH q AS (SELECT o_orderkey, o_custkey AS user_id, TIMESTAMP '2024-01-01' + INTERVAL (o_orderkey % 30) DAY AS ts FROM orders),
e AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'signup' GROUP BY 1, 2)
SELECT o_orderkey, event_id FROM q ASOF LEFT JOIN e ON q.user_id = e.user_id AND q.ts >= e.ts""")
def j15(spark, d) -> DataFrame:
    """As-of without an inequality join: both sides in one sorted stream, last value carried."""
    at = F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(o_orderkey % 30)")
    q = table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), at.alias("ts"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("event_id"), "o_orderkey")
    e = table(spark, d, "events").where("event_type = 'signup' AND user_id IS NOT NULL AND ts IS NOT NULL").select("user_id", "ts", F.lit(0).alias("side"), "event_id", F.lit(None).cast("long").alias("o_orderkey"))
    w = Window.partitionBy("user_id").orderBy("ts", "side", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return q.unionByName(e).withColumn("event_id", F.last("event_id", ignorenulls=True).over(w)).where("side = 1").select("o_orderkey", "event_id")


@R.add("j16_state_at_checkpoints", """
WITH c(cut) AS (VALUES (5), (10), (20), (30))
SELECT user_id, cut, count(*) AS n, round(sum(value), 4) AS spent, count(*) FILTER (WHERE event_type = 'error') AS errors FROM c JOIN events ON ts < TIMESTAMP '2024-01-01' + INTERVAL (cut) DAY GROUP BY 1, 2""")
def j16(spark, d) -> DataFrame:
    days = F.datediff(F.col("ts"), F.lit("2024-01-01"))
    cuts = F.filter(F.array(*map(F.lit, (5, 10, 20, 30))), lambda c: days < c)
    e = table(spark, d, "events").withColumn("cut", F.explode(cuts))
    return e.groupBy("user_id", "cut").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("spent"), F.count_if(F.col("event_type") == "error").alias("errors"))


@R.add("j18_layer_difference", """
SELECT l_orderkey, round(sum(l_extendedprice), 4) AS size FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size < 10) GROUP BY 1""")
def j18(spark, d) -> DataFrame:
    base = table(spark, d, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, d, "lineitem").join(base, "l_partkey", "left_anti").groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 4).alias("size"))


@R.add("j19_first_match_in_menu_order", """
WITH m(pos, pat) AS (VALUES (1, 'red'), (2, 'ring'), (3, 'small'), (4, 'blue'))
SELECT p_partkey, arg_min(pat, pos) AS choice FROM part JOIN m ON contains(p_name, pat) GROUP BY 1""")
def j19(spark, d) -> DataFrame:
    menu = ("red", "ring", "small", "blue")
    choice = F.coalesce(*[F.when(F.col("p_name").contains(m), m) for m in menu])
    return table(spark, d, "part").select("p_partkey", choice.alias("choice")).where("choice is not null")


@R.add("j20_one_input_per_session", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS inputs FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def j20(spark, d) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.countDistinct("o_orderstatus").alias("inputs")).where("inputs > 1")


@R.add("j21_forward_as_of_and_phase", """
SELECT event_id, first_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_purchase,
  CAST(count(*) FILTER (WHERE event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS phase FROM events""")
def j21(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    t = F.col("event_type")
    nxt = F.first(F.when(t == "purchase", F.col("event_id")), ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return table(spark, d, "events").select("event_id", nxt.alias("next_purchase"), F.count_if(t == "signup").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("phase"))


@R.add("a39_max_per_key_with_name", "SELECT l_partkey, max(l_extendedprice) AS most, arg_max(l_orderkey, (l_extendedprice, l_orderkey)) AS who FROM lineitem GROUP BY 1")
def a39(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.max("l_extendedprice").alias("most"), F.max_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey")).alias("who"))
