"""What a conversation shows: ordered results, compactions, edits, forks, and views of
tasks. The events of a user stand in for a path of entries in the order of event_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import contexts, graphs
from ..sources.tables import table
from .pairs import scan
from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

_K = "CAST(json_extract(props, '$.k') AS BIGINT)"


def entries(spark, d) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.col("event_type").alias("kind"), k.alias("k"))


@R.add("d10_ordered_tool_results", f"""
WITH e AS (SELECT user_id, event_id AS id, event_type AS kind, {_K} AS k, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id) AS turn FROM events),
c AS (SELECT user_id, id, turn, unnest([k % 5, (k + 2) % 5]) AS call, unnest([1, 2]) AS nth FROM e WHERE kind = 'purchase'),
r AS (SELECT user_id, turn, k % 5 AS call, min(id) AS result FROM e WHERE kind = 'view' GROUP BY ALL),
o AS (SELECT user_id, id, 0 AS nth, id AS shown, kind FROM e WHERE kind <> 'view' UNION ALL SELECT c.user_id, c.id, nth, result, CASE WHEN result IS NULL THEN 'missing' ELSE 'result' END FROM c LEFT JOIN r USING (user_id, turn, call))
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY id, nth) AS place, shown, kind FROM o""")
def d10(spark, d) -> DataFrame:
    """Purchases call (two calls each), views answer."""
    e = entries(spark, d)
    calls = F.when(F.col("kind") == "purchase", F.array(F.col("k") % 5, (F.col("k") + 2) % 5))
    answers = F.when(F.col("kind") == "view", F.col("k") % 5)
    out = contexts.ordered_results(e.select("user_id", "id", "kind", calls.alias("calls"), answers.alias("answers")), "user_id")
    return out.select("user_id", "place", "shown", "kind")


_PATH = f"""
WITH e AS (SELECT user_id, event_id AS id, event_type AS kind, {_K} AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
c AS (SELECT user_id, max(i) AS ci, arg_max(i - k % 6 - 1, i) AS first FROM e WHERE kind = 'signup' GROUP BY 1),
x AS (SELECT e.*, CASE WHEN ci IS NULL THEN i WHEN i = ci THEN 0 WHEN i > ci THEN i WHEN first >= 1 AND i >= first AND kind <> 'error' THEN i END AS pos FROM e LEFT JOIN c USING (user_id)) """


def compacted(spark, d) -> DataFrame:
    """Signups are compactions that keep from the (k % 6 + 1)th entry before them; errors are system entries."""
    e = entries(spark, d).withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("id")))
    keep = F.when(F.col("kind") == "signup", F.col("i") - F.col("k") % 6 - 1)
    return contexts.context_entries(e.select("user_id", "id", "kind", "k", "i", (F.col("kind") == "signup").alias("compacts"), keep.alias("keep_from"), (F.col("kind") == "error").alias("system")), "user_id")


@R.add("d12_compacted_context", _PATH + "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS place, id FROM x WHERE pos IS NOT NULL")
def d12(spark, d) -> DataFrame:
    return compacted(spark, d).select("user_id", "place", "id")


@R.add("d13_edited_projection", _PATH + """, n AS (SELECT user_id, id, kind, k, i, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS place FROM x WHERE pos IS NOT NULL),
t AS (SELECT user_id, i - k % 4 - 1 AS i, arg_max(k, place) AS k FROM n WHERE kind = 'view' GROUP BY ALL)
SELECT n.user_id, place, id, CASE WHEN n.kind = 'signup' THEN 'summary' WHEN t.k IS NULL THEN 'as it was' ELSE 'edited ' || t.k END AS shown FROM n LEFT JOIN t USING (user_id, i)
WHERE n.kind <> 'view' AND NOT (n.kind = 'signup' AND place > 1) AND coalesce(t.k, 0) <= 80""")
def d13(spark, d) -> DataFrame:
    """Views are edits of an entry a few places before; an edit with k over 80 takes it out."""
    c = compacted(spark, d)
    edits = c.where("kind = 'view'").select("user_id", (F.col("i") - F.col("k") % 4 - 1).alias("i"), "place", F.col("k").alias("edit"))
    newest = contexts.newest_edit(edits, ["user_id", "i"], "edit")
    shown = F.when(F.col("kind") == "signup", "summary").when(F.col("edit").isNull(), "as it was").otherwise(F.concat(F.lit("edited "), F.col("edit").cast("string")))
    j = c.join(newest, ["user_id", "i"], "left").where("kind <> 'view' and not (kind = 'signup' and place > 1) and coalesce(edit, 0) <= 80")
    return j.select("user_id", "place", "id", shown.alias("shown"))


# forks: nations are conversations, each from the one five before it, and customers their entries

_CHAIN = """
WITH RECURSIVE c AS (SELECT n_nationkey AS conv, CASE WHEN n_nationkey >= 5 THEN n_nationkey - 5 END AS parent, n_nationkey * 40 AS cut FROM nation),
r(conv, anc, up, distance) AS (SELECT conv, conv, 1000000000, 0 FROM c UNION ALL SELECT r.conv, c.parent, least(r.up, c.cut), distance + 1 FROM r JOIN c ON r.anc = c.conv WHERE c.parent IS NOT NULL),
v AS (SELECT r.conv, distance, c_custkey AS id, c_acctbal, c_mktsegment FROM r JOIN customer ON c_nationkey = anc AND c_custkey <= up) """


def visible(spark, d) -> DataFrame:
    """(conv, distance, id, ...) of the entries that each conversation sees, its own at distance 0."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), (F.col("n_nationkey") * 40).cast("long").alias("cut"))
    forks = n.select("node", F.when(F.col("node") >= 5, F.col("node") - 5).alias("parent"), "cut")
    chain = graphs.fork_chain(forks)
    own = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("ancestor"), F.col("c_custkey").alias("id"), "c_acctbal", "c_mktsegment")
    seen = chain.join(own, "ancestor").where(F.col("limit").isNull() | (F.col("id") <= F.col("limit")))
    return seen.select(F.col("node").cast("int").alias("conv"), "distance", "id", "c_acctbal", "c_mktsegment")


@R.add("d8_newest_head_marker", _CHAIN + "SELECT conv, arg_min(id, (distance, -id)) AS head FROM v WHERE c_acctbal > 9000 GROUP BY 1")
def d8(spark, d) -> DataFrame:
    """The newest marker of the nearest conversation on the chain that has one."""
    near = F.struct("distance", -F.col("id"))
    return visible(spark, d).where("c_acctbal > 9000").groupBy("conv").agg(F.min_by("id", near).alias("head"))


@R.add("k5_newest_first_over_ancestors", _CHAIN + "SELECT conv, id, row_number() OVER (PARTITION BY conv ORDER BY distance, id DESC) AS place FROM v WHERE c_acctbal > 0 QUALIFY place <= 11")
def k5(spark, d) -> DataFrame:
    """A page of ten and the row that tells whether more follow: own entries newest first, then the parent's."""
    w = Window.partitionBy("conv").orderBy("distance", F.desc("id"))
    return visible(spark, d).where("c_acctbal > 0").withColumn("place", F.row_number().over(w)).where("place <= 11").select("conv", "id", "place")


@R.add("d7_copy_on_fork", """
SELECT n_nationkey AS conv, c_mktsegment AS document, CASE c_mktsegment WHEN 'BUILDING' THEN max(c_custkey) FILTER (WHERE c_custkey <= n_nationkey * 40) WHEN 'MACHINERY' THEN max(c_custkey) END AS content
FROM nation JOIN customer ON c_nationkey = n_nationkey - 5 GROUP BY ALL""".replace("CASE c_mktsegment WHEN 'BUILDING' THEN max(c_custkey) FILTER (WHERE c_custkey <= n_nationkey * 40)", "CASE c_mktsegment WHEN 'BUILDING' THEN max(CASE WHEN c_custkey <= n_nationkey * 40 THEN c_custkey END)").replace("GROUP BY ALL", "GROUP BY n_nationkey, c_mktsegment"))
def d7(spark, d) -> DataFrame:
    """What a fork copies from its parent: one document as of the fork, one as it is now, the others anew."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("conv"), (F.col("n_nationkey") - 5).alias("parent"))
    own = table(spark, d, "customer").select(F.col("c_nationkey").alias("parent"), F.col("c_mktsegment").alias("document"), F.col("c_custkey").alias("id"))
    g = n.join(own, "parent").groupBy("conv", "document").agg(F.max(F.when(F.col("id") <= F.col("conv") * 40, F.col("id"))).alias("then"), F.max("id").alias("now"))
    return g.select("conv", "document", F.when(F.col("document") == "BUILDING", F.col("then")).when(F.col("document") == "MACHINERY", F.col("now")).alias("content"))


@R.add("s22_keyset_scans", """
WITH a AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY 1 LIMIT 51), b AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey > (SELECT max(o_orderkey) FROM (SELECT o_orderkey FROM a ORDER BY 1 LIMIT 50)) ORDER BY 1 LIMIT 51)
SELECT 1 AS page, o_orderkey FROM a UNION ALL SELECT 2, o_orderkey FROM b""")
def s22(spark, d) -> DataFrame:
    """Two pages of 50, each with the row that tells whether more follow; the cursor is the first page's 50th key."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    one = scan(o, {"o_orderstatus": "F"}, "o_orderkey", None, 50)
    cursor = [r[0] for r in one.select("o_orderkey").collect()][:50][-1]  # a page
    two = scan(o, {"o_orderstatus": "F"}, "o_orderkey", cursor, 50)
    return one.select(F.lit(1).alias("page"), "o_orderkey").unionByName(two.select(F.lit(2).alias("page"), "o_orderkey"))


@R.add("t5_task_graph", """
WITH o AS (SELECT o_custkey AS owner, o_orderkey AS task, o_orderstatus AS s, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS parent FROM orders)
SELECT a.owner, a.task, a.parent, CASE WHEN a.s = 'P' THEN 'running' WHEN b.s = 'P' THEN 'blocks' WHEN a.s = 'O' THEN 'waiting' ELSE 'done' END AS state, count(b.task) AS children FROM o a LEFT JOIN o b ON b.parent = a.task AND b.owner = a.owner GROUP BY ALL""")
def t5(spark, d) -> DataFrame:
    """Tasks of an owner in a chain, each with its own and its child's state."""
    w = Window.partitionBy("owner").orderBy("task")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("task"), F.col("o_orderstatus").alias("s"))
    g = o.select("owner", "task", F.lag("task").over(w).alias("parent"), "s", F.lead("s").over(w).alias("c"))
    state = F.when(F.col("s") == "P", "running").when(F.col("c") == "P", "blocks").when(F.col("s") == "O", "waiting").otherwise("done")
    return g.select("owner", "task", "parent", state.alias("state"), F.col("c").isNotNull().cast("long").alias("children"))


@R.add("j22_novelty_of_a_target", """
WITH t AS (SELECT conv_id, turn, text, lower(regexp_extract(text, '[[:alpha:]]{4,}', 0)) AS target FROM conversations),
p AS (SELECT *, first_value(text) OVER w AS task, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS recent, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, target, CASE WHEN turn > 0 AND contains(lower(task), target) THEN 'task' WHEN contains(lower(recent), target) THEN 'recent' WHEN contains(lower(before), target) THEN 'earlier' ELSE 'new' END AS seen FROM p WHERE target <> ''""".replace("[[:alpha:]]", "[A-Za-z]"))
def j22(spark, d) -> DataFrame:
    """Where the target of a turn (its first word of four letters) was named before. What a
    conversation said so far is carried along with each of its turns."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    said = lambda a, b: F.array_join(F.collect_list("text").over(w.rowsBetween(a, b)), " ")
    t = table(spark, d, "conversations").withColumn("target", F.lower(F.regexp_extract("text", "[A-Za-z]{4,}", 0)))
    p = t.select("conv_id", "turn", "target", F.first("text").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("task"), said(-2, -1).alias("recent"), said(Window.unboundedPreceding, -1).alias("before"))
    has = lambda c: F.contains(F.lower(c), F.col("target"))
    seen = F.when((F.col("turn") > 0) & has("task"), "task").when(has("recent"), "recent").when(has("before"), "earlier").otherwise("new")
    return p.where("target <> ''").select("conv_id", "turn", "target", seen.alias("seen"))
