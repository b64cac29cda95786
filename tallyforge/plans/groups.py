"""Grouping, splits, sampling, models and the temporal store on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import graphs, models, similarity, tasks
from ..sources.tables import table
from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


def _hash(seed: str, c) -> F.Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), c.cast("string")).cast("binary"), 256)


_RULES = """g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS a, min(doc_id) OVER (PARTITION BY source, n_chars) AS b FROM documents)"""


@R.add("g1_components_of_copies", f"""
WITH RECURSIVE {_RULES}, e AS (SELECT doc_id AS x, a AS y FROM g UNION SELECT a, doc_id FROM g UNION SELECT doc_id, b FROM g UNION SELECT b, doc_id FROM g),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT x AS doc_id, min(y) AS component FROM r GROUP BY 1""")
def g1(spark, d) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text"), "source", "n_chars")
    sized = F.when(F.col("source").isNotNull() & F.col("n_chars").isNotNull(), F.concat_ws(":", F.col("n_chars").cast("string"), "source"))
    edges = graphs.alike(t, "doc_id", F.col("text")).unionByName(graphs.alike(t, "doc_id", sized))
    out = graphs.components(edges, t.select(F.col("doc_id").alias("node")))
    return out.select(F.col("node").alias("doc_id"), "component")


@R.add("g2_link_union", """
WITH k AS (SELECT doc_id, 'text' AS rule, text AS key FROM documents UNION ALL SELECT doc_id, 'name', lower(regexp_extract(text, '[A-Za-z]+', 0)) || ':' || n_chars FROM documents UNION ALL SELECT doc_id, 'topic', left(text, 40) FROM documents
  UNION ALL SELECT doc_id, 'exercise', source || ':' || n_chars FROM documents UNION ALL SELECT doc_id, 'family', right(text, 40) FROM documents UNION ALL SELECT doc_id, 'hand', CASE WHEN doc_id IN (3, 5, 8) THEN 'list' END FROM documents)
SELECT rule, doc_id AS a, min(doc_id) OVER (PARTITION BY rule, key) AS b FROM k WHERE key IS NOT NULL QUALIFY a <> b""")
def g2(spark, d) -> DataFrame:
    """Links by six rules (text, name, topic, exercise, family, a list made by hand): each
    document to the smallest of its rule and key, so a key of n documents gives n - 1 links."""
    t = table(spark, d, "documents").select("doc_id", "text", "source", "n_chars")
    size = F.col("n_chars").cast("string")
    keys = {
        "text": F.sha2("text", 256), "name": F.concat(F.lower(F.regexp_extract("text", "[A-Za-z]+", 0)), F.lit(":"), size), "topic": F.left("text", F.lit(40)), "exercise": F.concat("source", F.lit(":"), size),
        "family": F.right("text", F.lit(40)), "hand": F.when(F.col("doc_id").isin(3, 5, 8), "list"),
    }
    rows = t.select(F.col("doc_id").alias("a"), F.explode(F.create_map(*[x for rule, c in keys.items() for x in (F.lit(rule), c)])).alias("rule", "key")).where("key is not null")
    least = rows.groupBy("rule", "key").agg(F.min("a").alias("b"))
    return rows.join(least, ["rule", "key"]).where("a <> b").select("rule", "a", "b")


@R.add("g3_group_side_by_precedence", """
SELECT source, CASE WHEN bool_or(lang = 'es') THEN 'training' WHEN bool_or(n_chars > 100000) THEN 'held out' ELSE 'draw' END AS side, count(*) AS n FROM documents GROUP BY 1""")
def g3(spark, d) -> DataFrame:
    side = F.when(F.bool_or(F.col("lang") == "es"), "training").when(F.bool_or(F.col("n_chars") > 100000), "held out").otherwise("draw")
    return table(spark, d, "documents").groupBy("source").agg(side.alias("side"), F.count("*").alias("n"))


#: Groups of one greedy draw; they are folded in one task.
MOST_GROUPS = 1_000_000


def greedy_draw(groups: DataFrame, key: str, size: str, target: int, seed: str) -> DataFrame:
    """Whole groups in hash order while they fit the target; one that would overshoot is
    skipped. Whether a group is taken depends on all before it, so the fold runs in one
    aggregate over the group sizes (16 bytes of hash and a size each), of which there may be
    MOST_GROUPS; more raise."""
    n = groups.count()
    if n > MOST_GROUPS:
        raise ValueError(f"{n} groups; a draw takes {MOST_GROUPS} at most")
    packed = groups.groupBy().agg(F.sort_array(F.collect_list(F.struct(_hash(seed, F.col(key)).alias("h"), F.col(key).alias("k"), F.col(size).cast("long").alias("n")))).alias("g"))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast(f"array<{dict(groups.dtypes)[key]}>").alias("taken"))
    fold = F.aggregate("g", start, lambda s, x: F.when(s["sum"] + x["n"] <= target, F.struct((s["sum"] + x["n"]).alias("sum"), F.concat(s["taken"], F.array(x["k"])).alias("taken"))).otherwise(s))
    return packed.select(F.explode(fold["taken"]).alias(key))


@R.add("g4_greedy_group_draw", """
WITH RECURSIVE g AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY sha256('5:' || source)) AS i, (SELECT count(*) FROM documents) // 3 AS t FROM documents GROUP BY 1),
f AS (SELECT 0 AS i, CAST(0 AS BIGINT) AS s, '' AS source, false AS took UNION ALL SELECT g.i, CASE WHEN f.s + g.n <= g.t THEN f.s + g.n ELSE f.s END, g.source, f.s + g.n <= g.t FROM f JOIN g ON g.i = f.i + 1)
SELECT source FROM f WHERE took""")
def g4(spark, d) -> DataFrame:
    t = table(spark, d, "documents")
    return greedy_draw(t.groupBy("source").agg(F.count("*").alias("n")), "source", "n", t.count() // 3, "5")


@R.add("g5_exclusion_rules", """
SELECT CASE WHEN n_chars < 100 THEN 'short' WHEN contains(text, '@') THEN 'mail' WHEN lang = 'de' THEN 'language' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1""")
def g5(spark, d) -> DataFrame:
    reason = F.when(F.col("n_chars") < 100, "short").when(F.col("text").contains("@"), "mail").when(F.col("lang") == "de", "language").otherwise("kept")
    return table(spark, d, "documents").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@R.add("g8_first_n_in_hash_order", """
SELECT source, CASE WHEN r <= 3 THEN 'development' WHEN r <= 6 THEN 'temperature' ELSE 'train' END AS split FROM (SELECT source, row_number() OVER (ORDER BY sha256('9:' || source)) AS r FROM (SELECT DISTINCT source FROM documents))""")
def g8(spark, d) -> DataFrame:
    s = table(spark, d, "documents").select("source").distinct().withColumn("h", _hash("9", F.col("source")))
    first = s.orderBy("h").limit(6).withColumn("r", F.row_number().over(Window.orderBy("h")))  # six rows
    j = s.join(first.select("source", "r"), "source", "left")
    return j.select("source", F.when(F.col("r") <= 3, "development").when(F.col("r") <= 6, "temperature").otherwise("train").alias("split"))


@R.add("g9_folds_by_hash", """
SELECT doc_id, CAST(CASE WHEN u < 0.2 THEN -1 ELSE least(floor((u - 0.2) / (1 - 0.2) * 5), 4) END AS INTEGER) AS fold FROM (SELECT doc_id, CAST('0x' || substr(sha256('2:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM labels)""")
def g9(spark, d) -> DataFrame:
    return models.folds(table(spark, d, "labels").select("doc_id"), "doc_id", 5, 0.2, "2")


@R.add("g6_whole_family_sample", """
WITH RECURSIVE c AS (SELECT lang || ':' || source AS family, count(*) AS n FROM documents GROUP BY 1), g AS (SELECT family, n, row_number() OVER (ORDER BY sha256('3:' || family)) AS i FROM c),
f AS (SELECT 0 AS i, CAST(0 AS BIGINT) AS s, '' AS family, false AS took UNION ALL SELECT g.i, CASE WHEN f.s + g.n <= 100 THEN f.s + g.n ELSE f.s END, g.family, f.s + g.n <= 100 FROM f JOIN g ON g.i = f.i + 1)
SELECT doc_id FROM documents WHERE lang || ':' || source IN (SELECT family FROM f WHERE took)""")
def g6(spark, d) -> DataFrame:
    """All rows of whole families in hash order, a family that would overshoot the cap left out."""
    t = table(spark, d, "documents").select("doc_id", F.concat_ws(":", "lang", "source").alias("family"))
    return sampled_families(t, "family", 100, "3").select("doc_id")


def sampled_families(rows: DataFrame, family: str, target: int, seed: str, exact: bool = False) -> DataFrame:
    """Rows of whole families, `target` at most; exact raises where the target is not met."""
    sizes = rows.groupBy(family).agg(F.count("*").alias("n"))
    taken = greedy_draw(sizes, family, "n", target, seed)
    if exact:
        got = sizes.join(taken, family, "left_semi").agg(F.sum("n").alias("n")).first()["n"] or 0
        if got != target:
            raise ValueError(f"whole families give {got} rows, not the target {target}")
    return rows.join(taken, family, "left_semi")


@R.add("g7_hash_split_by_group", """
SELECT split, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (SELECT doc_id, CASE WHEN u < 0.15 THEN 'development' ELSE 'train' END AS split FROM (SELECT doc_id, CAST('0x' || substr(sha256('21:' || source || '/' || lang), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents)) GROUP BY 1""")
def g7(spark, d) -> DataFrame:
    """All rows of a group fall on the same side."""
    u = stats.hash_fraction(F.concat(F.lit("21:"), "source", F.lit("/"), "lang"))
    t = table(spark, d, "documents").select("doc_id", F.when(u < 0.15, "development").otherwise("train").alias("split"))
    return t.groupBy("split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@R.add("g10_leak_check", "SELECT DISTINCT d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def g10(spark, d) -> DataFrame:
    """Documents that hold a benchmark text whole."""
    return similarity.containing(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "benchmark"), "text")


@R.add("g11_deterministic_option_order", "SELECT n_regionkey AS r, string_agg(n_name, ',' ORDER BY sha256(n_regionkey || '|' || n_name)) AS options FROM nation GROUP BY 1")
def g11(spark, d) -> DataFrame:
    h = F.sha2(F.concat(F.col("n_regionkey").cast("string"), F.lit("|"), "n_name").cast("binary"), 256)
    o = F.sort_array(F.collect_list(F.struct(h.alias("h"), "n_name")))
    return table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("r")).agg(F.array_join(F.transform(o, lambda x: x["n_name"]), ",").alias("options"))


@R.add("g12_stratified_quota", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang, n_chars > 1000 ORDER BY sha256('4:' || doc_id)) <= 12")
def g12(spark, d) -> DataFrame:
    w = Window.partitionBy("lang", "big").orderBy("h")
    t = table(spark, d, "documents").select("doc_id", "lang", (F.col("n_chars") > 1000).alias("big"), _hash("4", F.col("doc_id")).alias("h"))
    return t.withColumn("r", F.row_number().over(w)).where("r <= 12").select("doc_id")


@R.add("g13_large_cases_and_hash_sample", "SELECT doc_id FROM documents WHERE n_chars > 8000 UNION ALL (SELECT doc_id FROM documents WHERE n_chars BETWEEN 2000 AND 8000 ORDER BY sha256('6:' || doc_id) LIMIT 20)")
def g13(spark, d) -> DataFrame:
    t = table(spark, d, "documents")
    mid = t.where("n_chars between 2000 and 8000").orderBy(_hash("6", F.col("doc_id"))).limit(20)
    return t.where("n_chars > 8000").select("doc_id").unionByName(mid.select("doc_id"))


@R.add("g14_second_draw_without_the_first", """
WITH f AS (SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('1:' || doc_id)) <= 5)
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM f) AND n_chars < 3000 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha256('2:' || doc_id)) <= 5""")
def g14(spark, d) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    take = lambda df, seed: df.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(_hash(seed, F.col("doc_id"))))).where("r <= 5")
    rest = t.join(take(t, "1").select("doc_id"), "doc_id", "left_anti").where("n_chars < 3000")
    return take(rest, "2").select("doc_id")


# models


def labelled(spark, d) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


@R.add("m1_standardised_features", """
WITH l AS (SELECT doc_id, ln(1 + n_chars) AS x, lang FROM labels JOIN documents USING (doc_id))
SELECT doc_id, round((x - (SELECT avg(x) FROM l)) / (SELECT stddev_pop(x) FROM l), 6) AS z, CAST(lang = 'en' AS INTEGER) AS en, CAST(lang = 'de' AS INTEGER) AS de FROM l""")
def m1(spark, d) -> DataFrame:
    l = labelled(spark, d).withColumn("x", F.log1p("n_chars"))
    s = l.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))  # one row
    return l.crossJoin(F.broadcast(s)).select("doc_id", F.round((F.col("x") - F.col("m")) / F.col("s"), 6).alias("z"), (F.col("lang") == "en").cast("int").alias("en"), (F.col("lang") == "de").cast("int").alias("de"))


@R.add("m2_logistic_regression")
def m2(spark, d) -> DataFrame:
    l = labelled(spark, d).withColumn("x", F.log1p("n_chars"))
    w = models.logistic(l, ["x"], "quality")
    return spark.createDataFrame([("intercept", round(w[0], 6)), ("log_chars", round(w[1], 6))], "name string, weight double")


@R.add("m3_gini_tree")
def m3(spark, d) -> DataFrame:
    return models.gini_stump_tree(labelled(spark, d), ["n_chars"], "quality")


@R.add("m4_smoothed_cells", """
WITH l AS (SELECT lang, n_chars > 1000 AS big, quality FROM labels JOIN documents USING (doc_id)), p AS (SELECT lang, avg(quality) AS prior FROM l GROUP BY 1)
SELECT lang, big, count(*) AS n, round((sum(quality) + 5 * max(prior)) / (count(*) + 5), 8) AS rate FROM l JOIN p USING (lang) GROUP BY 1, 2""")
def m4(spark, d) -> DataFrame:
    l = labelled(spark, d).withColumn("big", F.col("n_chars") > 1000)
    return models.cell_table(l, ["lang"], ["lang", "big"], "quality").select("lang", "big", "n", F.round("rate", 8).alias("rate"))


@R.add("m5_out_of_fold_rates", """
WITH l AS (SELECT doc_id, lang, quality, CAST('0x' || substr(sha256('8:' || doc_id), 1, 13) AS BIGINT) % 5 AS fold FROM labels JOIN documents USING (doc_id)),
t AS (SELECT lang, fold, sum(quality) AS k, count(*) AS n FROM l GROUP BY 1, 2), a AS (SELECT lang, sum(k) AS k, sum(n) AS n FROM t GROUP BY 1)
SELECT doc_id, round((a.k - t.k + 1) / (a.n - t.n + 2), 8) AS rate FROM l JOIN t USING (lang, fold) JOIN a USING (lang)""")
def m5(spark, d) -> DataFrame:
    """Predictions of each fold from the sums of the others, in one pass."""
    fold = F.conv(F.substring(_hash("8", F.col("doc_id")), 1, 13), 16, 10).cast("long") % 5
    l = labelled(spark, d).withColumn("fold", fold)
    t = l.groupBy("lang", "fold").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    w = Window.partitionBy("lang")
    rest = t.select("lang", "fold", ((F.sum("k").over(w) - F.col("k") + 1) / (F.sum("n").over(w) - F.col("n") + 2)).alias("rate"))
    return l.join(rest, ["lang", "fold"]).select("doc_id", F.round("rate", 8).alias("rate"))


@R.add("m6_auc", """
WITH l AS (SELECT n_chars AS s, quality AS y FROM labels JOIN documents USING (doc_id)), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM l)
SELECT round((sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 9) AS auc FROM r""")
def m6(spark, d) -> DataFrame:
    return models.auc(labelled(spark, d), "n_chars", "quality").select(F.round("auc", 9).alias("auc"))


@R.add("a43_least_squares", """
SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem""")
def a43(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 4).alias("intercept"), F.round(F.regr_slope("l_extendedprice", "l_quantity"), 6).alias("slope"), F.round(F.regr_r2("l_extendedprice", "l_quantity"), 6).alias("r2"))


# temporal store: events as a commit log (event_id is the sequence, user the document)


@R.add("d2_latest_per_id", "SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY 1")
def d2(spark, d) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"), F.max("event_id").alias("seq"))


@R.add("d3_id_ownership_violations", "SELECT id, count(*) AS owners FROM (SELECT c_custkey AS id FROM customer UNION ALL SELECT s_suppkey FROM supplier) GROUP BY 1 HAVING count(*) > 1")
def d3(spark, d) -> DataFrame:
    ids = table(spark, d, "customer").select(F.col("c_custkey").alias("id")).unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id")))
    return ids.groupBy("id").agg(F.count("*").alias("owners")).where("owners > 1")


_LIVE = "WITH l AS (SELECT user_id, event_id AS created, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS retired FROM events WHERE event_type = 'signup') "


def incarnations(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").where("event_type = 'signup'").select("user_id", F.col("event_id").alias("created"), F.lead("event_id").over(w).alias("retired"))


@R.add("d4_one_live_incarnation", _LIVE + "SELECT user_id, count(*) AS live FROM l WHERE retired IS NULL GROUP BY 1")
def d4(spark, d) -> DataFrame:
    return incarnations(spark, d).where("retired is null").groupBy("user_id").agg(F.count("*").alias("live"))


@R.add("f9_alive_at", _LIVE + "SELECT user_id, created FROM l WHERE created <= 500 AND (retired IS NULL OR 500 < retired)")
def f9(spark, d) -> DataFrame:
    return incarnations(spark, d).where("created <= 500 and (retired is null or 500 < retired)").select("user_id", "created")


@R.add("d9_context_projection", """
WITH h AS (SELECT conv_id, max(turn) FILTER (WHERE role = 'user') AS head FROM conversations GROUP BY 1)
SELECT conv_id, turn, CASE WHEN length(text) > 1000 THEN '[replaced]' ELSE role END AS shown FROM conversations JOIN h USING (conv_id) WHERE turn >= head - 2 AND role <> 'system'""")
def d9(spark, d) -> DataFrame:
    head = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    t = table(spark, d, "conversations").withColumn("head", head).where("turn >= head - 2 and role <> 'system'")
    return t.select("conv_id", "turn", F.when(F.length("text") > 1000, "[replaced]").otherwise(F.col("role")).alias("shown"))


@R.add("d11_root_paths", """
WITH RECURSIVE p AS (SELECT conv_id * 1000 + turn AS node, CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent FROM conversations),
r(node, ancestor, distance) AS (SELECT node, node, 0 FROM p UNION ALL SELECT r.node, p.parent, r.distance + 1 FROM r JOIN p ON r.ancestor = p.node WHERE p.parent IS NOT NULL)
SELECT node, ancestor, distance FROM r""")
def d11(spark, d) -> DataFrame:
    id_ = F.col("conv_id") * 1000 + F.col("turn")
    return graphs.root_paths(table(spark, d, "conversations").select(id_.alias("node"), F.when(F.col("turn") > 0, id_ - 1).alias("parent")))


@R.add("d14_session_info", """
SELECT conv_id, count(*) AS messages, arg_min(text, turn) FILTER (WHERE role = 'user') AS first_user, max(turn) AS last, arg_max(role, turn) AS last_role, sha256(string_agg(text, chr(10) ORDER BY turn)) AS all_text FROM conversations GROUP BY 1""")
def d14(spark, d) -> DataFrame:
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return table(spark, d, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("messages"), F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("first_user"), F.max("turn").alias("last"), F.max_by("role", "turn").alias("last_role"),
        F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("all_text"),
    )


@R.add("d15_children_per_parent", "SELECT n_regionkey AS parent, count(*) AS children, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY 1")
def d15(spark, d) -> DataFrame:
    names = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"])
    return table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("parent")).agg(F.count("*").alias("children"), F.array_join(names, ",").alias("names"))


@R.add("d16_join_policies", """
SELECT o_custkey, bool_or(o_orderstatus = 'P') AS any_failed, bool_and(o_orderstatus <> 'O') AS all_settled, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'failed' WHEN bool_and(o_orderstatus <> 'O') THEN 'done' ELSE 'waiting' END AS fail_fast FROM orders GROUP BY 1""")
def d16(spark, d) -> DataFrame:
    failed, settled = F.bool_or(F.col("o_orderstatus") == "P"), F.bool_and(F.col("o_orderstatus") != "O")
    return table(spark, d, "orders").groupBy("o_custkey").agg(failed.alias("any_failed"), settled.alias("all_settled"), F.when(failed, "failed").when(settled, "done").otherwise("waiting").alias("fail_fast"))


@R.add("d17_garbage_before_base", "SELECT e.event_id FROM events e JOIN (SELECT user_id, max(event_id) AS base FROM events WHERE event_type = 'signup' GROUP BY 1) b USING (user_id) WHERE event_id < base")
def d17(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    base = e.where("event_type = 'signup'").groupBy("user_id").agg(F.max("event_id").alias("base"))
    return e.join(base, "user_id").where("event_id < base").select("event_id")


@R.add("j17_ancestry_visibility", """
WITH RECURSIVE c AS (SELECT n_nationkey AS conv, CASE WHEN n_nationkey >= 5 THEN n_nationkey - 5 END AS parent, n_nationkey * 40 AS cut FROM nation),
r(conv, anc, cut) AS (SELECT conv, conv, 1000000000 FROM c UNION ALL SELECT r.conv, c.parent, least(r.cut, c.cut) FROM r JOIN c ON r.anc = c.conv WHERE c.parent IS NOT NULL)
SELECT r.conv, count(*) AS visible FROM r JOIN customer ON c_nationkey = r.anc AND c_custkey <= r.cut GROUP BY 1""")
def j17(spark, d) -> DataFrame:
    """Entries of a conversation and its fork ancestors, each up to the smallest cut on the way."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), (F.col("n_nationkey") * 40).cast("long").alias("cut"))
    chain = graphs.fork_chain(n.select("node", F.when(F.col("node") >= 5, F.col("node") - 5).alias("parent"), "cut"))
    j = chain.join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("ancestor")).where(F.col("limit").isNull() | (F.col("c_custkey") <= F.col("limit")))
    return j.groupBy(F.col("node").cast("int").alias("conv")).agg(F.count("*").alias("visible"))


@R.add("t5_dependency_outlook", """
WITH RECURSIVE t AS (SELECT p_partkey AS task, CASE WHEN p_partkey % 11 = 0 THEN 'failed' WHEN p_partkey % 11 < 5 THEN 'done' ELSE 'open' END AS state, p_partkey % 2 = 0 AS fast FROM part),
n AS (SELECT task, task // 2 AS need FROM t WHERE task > 1 UNION SELECT task, task // 3 FROM t WHERE task % 5 < 2 AND task > 2 UNION SELECT task, task + 1 FROM t WHERE task % 50 = 27 UNION SELECT task, task - 1 FROM t WHERE task % 50 = 28),
up(task, need) AS (SELECT task, need FROM n UNION SELECT u.task, n.need FROM up u JOIN n ON n.task = u.need), c AS (SELECT DISTINCT task FROM up WHERE need IN (SELECT task FROM up WHERE task = need)),
dead(task) AS (SELECT task FROM t WHERE state = 'failed' UNION SELECT t.task FROM dead JOIN n ON n.need = dead.task JOIN t ON t.task = n.task WHERE t.state = 'open' AND t.fast),
k AS (SELECT n.task, count(*) AS needs, count(*) FILTER (WHERE t.state = 'done') AS done, count(*) FILTER (WHERE t.state = 'done' OR t.task IN (SELECT task FROM dead)) AS settled FROM n LEFT JOIN t ON t.task = n.need GROUP BY 1)
SELECT t.task, CASE WHEN state <> 'open' THEN state WHEN t.task IN (SELECT task FROM c) THEN 'circular' WHEN t.task IN (SELECT task FROM dead) THEN 'doomed' WHEN coalesce(needs, 0) = coalesce(CASE WHEN fast THEN done ELSE settled END, 0) THEN 'ready' ELSE 'waiting' END AS outlook
FROM t LEFT JOIN k ON k.task = t.task""")
def t5_outlook(spark, d) -> DataFrame:
    """Parts as tasks that need parts of smaller keys, a few of them each other."""
    k = F.col("task")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("task"))
    t = p.select("task", F.when(k % 11 == 0, "failed").when(k % 11 < 5, "done").otherwise("open").alias("state"), F.when(k % 2 == 0, "failFast").otherwise("allSettled").alias("policy"))
    edge = lambda when, need: p.where(when).select("task", need.cast("long").alias("need"))
    needs = edge("task > 1", F.floor(k / 2)).unionByName(edge("task % 5 < 2 and task > 2", F.floor(k / 3))).unionByName(edge("task % 50 = 27", k + 1)).unionByName(edge("task % 50 = 28", k - 1))
    return tasks.outlook(t, needs).select("task", "outlook")
