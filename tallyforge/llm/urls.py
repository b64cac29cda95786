"""URL filters with redirect equivalence, in DataFrame operations only.

A rule (host, path, action) fits a URL whose host is the rule's or below it and whose
path starts with the rule's; of several the longest counts, of equally long ones an
allow. Pages that redirect (`<meta http-equiv="refresh" content="0;url=...">`) or name a
canonical link (`<link rel="canonical" href="...">`) are aliases of where they point;
addresses joined by such edges, over any number of steps, form a component. An address
that no rule fits takes the decision of its component: allow if any address in it is
explicitly allowed, else block if any is blocked, else allow.

An address is host and path; scheme, query and fragment do not matter to any rule.
URLs that are null or lack `://` have an empty host and path, fit no rule and have no
edges: they are allowed. Repeated rows are judged alike; extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Most rules that go into each task as literals; more are joined by host suffix.
INLINE_RULES = 200
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Canonical links and refreshes, with the attributes in either order.
TARGETS = (
    ("canonical", r"""(?i)<link[^>]*rel\s*=\s*["']?canonical["']?[^>]*href\s*=\s*["']?([^"'\s>]+)"""),
    ("canonical", r"""(?i)<link[^>]*href\s*=\s*["']?([^"'\s>]+)["']?[^>]*rel\s*=\s*["']?canonical"""),
    ("refresh", r"""(?i)<meta[^>]*http-equiv\s*=\s*["']?refresh["']?[^>]*content\s*=\s*["']?[^"'>]*url\s*=\s*([^"'\s>]+)"""),
    ("refresh", r"""(?i)<meta[^>]*content\s*=\s*["']?[^"'>]*url\s*=\s*([^"'\s>]+)["']?[^>]*http-equiv\s*=\s*["']?refresh"""),
)


def address(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    there = url.isNotNull() & (at > 0)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.when(there, host).otherwise(F.lit("")), F.when(there, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def judged(addresses: DataFrame, rules=RULES) -> DataFrame:
    """addresses (host, path, ...) with rule (host and path joined) and action of the
    rule that decides, both null where none fits. rules: tuples, or a DataFrame
    (rule_host, rule_path, action) of any size."""
    spark = addresses.sparkSession
    (own,) = common.free_names(addresses, ["best"])
    if not isinstance(rules, DataFrame):
        if len(rules) <= INLINE_RULES:
            table = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(p).alias("p"), F.lit(a).alias("a")) for h, p, a in rules])
            fits = F.filter(table, lambda r: ((F.col("host") == r["h"]) | F.endswith("host", F.concat(F.lit("."), r["h"]))) & F.startswith("path", r["p"]))
            best = F.array_max(F.transform(fits, lambda r: F.struct((F.length(r["h"]) + F.length(r["p"])).alias("n"), (r["a"] == "allow").alias("ok"), F.concat(r["h"], r["p"]).alias("rule"))))
            return _decided(addresses.withColumn(own, best), own)
        rules = spark.createDataFrame(list(rules), "rule_host string, rule_path string, action string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = addresses.select("host", "path").distinct()
    near = each.withColumn("rule_host", F.explode(suffixes)).join(rules, "rule_host").where(F.startswith("path", F.col("rule_path")))
    order = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), (F.col("action") == "allow").alias("ok"), F.concat("rule_host", "rule_path").alias("rule"))
    best = near.groupBy("host", "path").agg(F.max(order).alias(own))
    return _decided(addresses.join(best, ["host", "path"], "left"), own)


def _decided(df: DataFrame, best: str) -> DataFrame:
    """df with rule and action in the place of its column `best`."""
    x = F.col(best)
    return df.withColumns({"rule": x["rule"], "action": F.when(x["ok"], "allow").when(x.isNotNull(), "block")}).drop(best)


def alias_edges(pages: DataFrame) -> DataFrame:
    """Edges (a, b) between addresses (host and path as one string) of pages (url, html)."""
    host, path = address(F.col("url"))
    rows = pages.select(host.alias("host"), path.alias("path"), "html").where("host <> '' and html is not null")
    found = [F.when(F.contains(F.lower("html"), F.lit(word)), F.regexp_extract("html", pattern, 1)).otherwise("") for word, pattern in TARGETS]
    to = rows.select("host", "path", F.explode(F.array_distinct(F.array_remove(F.array(*found), ""))).alias("to"))
    folder = F.regexp_replace("path", r"[^/]*$", "")
    whole = (
        F.when(F.contains("to", F.lit("://")), F.col("to"))
        .when(F.startswith("to", F.lit("//")), F.concat(F.lit("x:"), "to"))
        .when(F.startswith("to", F.lit("/")), F.concat(F.lit("x://"), "host", "to"))
        .otherwise(F.concat(F.lit("x://"), "host", F.when(folder == "", "/").otherwise(folder), "to"))
    )
    h, p = address(whole)
    ends = to.select(F.concat("host", "path").alias("a"), h.alias("h"), p.alias("p"))
    return ends.where("h <> ''").select("a", F.concat("h", "p").alias("b")).where("a <> b")


def verdicts(pages: DataFrame, rules=RULES, edges: DataFrame | None = None) -> DataFrame:
    """Per page (page_id, url, html): page_id, host, path, rule, verdict.

    edges adds known redirects (a, b), addresses as host and path in one string.
    """
    links = alias_edges(pages)
    if edges is not None:
        links = links.unionByName(edges.select("a", "b"))
    parts = common.connected_components(links, what="aliases")
    cut = F.instr("node", "/")
    split = parts.select("node", "component", F.when(cut > 0, F.substring_index("node", "/", 1)).otherwise(F.col("node")).alias("host"), F.when(cut > 0, F.substr("node", cut)).otherwise("").alias("path"))
    known = judged(split, rules).groupBy("component").agg(F.max((F.col("action") == "allow").cast("int")).alias("allowed"), F.max((F.col("action") == "block").cast("int")).alias("blocked"))
    method = F.when(F.col("allowed") == 1, "allow").when(F.col("blocked") == 1, "block")
    decided = parts.join(known, "component").select(F.col("node").alias("_node"), method.alias("_method")).where("_method is not null")
    host, path = address(F.col("url"))
    rows = judged(pages.select("page_id", host.alias("host"), path.alias("path")), rules)
    out = rows.join(decided, F.concat("host", "path") == F.col("_node"), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", "_method", F.lit("allow")).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))


QUERIES = {"op4_url_filter": op4_url_filter}
ORACLE_SQL = {
    "op4_url_filter": r"""
WITH RECURSIVE p AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), q AS (
  SELECT page_id, html, coalesce(lower(regexp_extract(rest, '^[^/?#]*')), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p
), rules(h, p, a) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), t AS (
  SELECT host, path, unnest([regexp_extract(html, '(?i)<link[^>]*rel\s*=\s*["'']?canonical["'']?[^>]*href\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(html, '(?i)<link[^>]*href\s*=\s*["'']?([^"''\s>]+)["'']?[^>]*rel\s*=\s*["'']?canonical', 1),
    regexp_extract(html, '(?i)<meta[^>]*http-equiv\s*=\s*["'']?refresh["'']?[^>]*content\s*=\s*["'']?[^"''>]*url\s*=\s*([^"''\s>]+)', 1),
    regexp_extract(html, '(?i)<meta[^>]*content\s*=\s*["'']?[^"''>]*url\s*=\s*([^"''\s>]+)["'']?[^>]*http-equiv\s*=\s*["'']?refresh', 1)]) AS target
  FROM q WHERE host <> '' AND html IS NOT NULL
), w AS (
  SELECT host || path AS a, CASE WHEN contains(target, '://') THEN target WHEN starts_with(target, '//') THEN 'x:' || target
    WHEN starts_with(target, '/') THEN 'x://' || host || target
    ELSE 'x://' || host || coalesce(nullif(regexp_replace(path, '[^/]*$', ''), ''), '/') || target END AS url
  FROM t WHERE target <> ''
), e AS (
  SELECT a, lower(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*')) || regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) AS b FROM w
), both_ways AS (
  SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b
), reach(a, b) AS (
  SELECT a, a FROM both_ways UNION SELECT r.a, x.b FROM reach r JOIN both_ways x ON r.b = x.a
), near AS (
  SELECT r.a AS node, n.rule_action FROM reach r JOIN (
    SELECT node, arg_max(a, length(h) + length(p)) AS rule_action FROM (SELECT DISTINCT b AS node FROM reach) JOIN rules
    ON (split_part(node, '/', 1) = h OR ends_with(split_part(node, '/', 1), '.' || h)) AND starts_with(CASE WHEN strpos(node, '/') > 0 THEN substr(node, strpos(node, '/')) ELSE '' END, p)
    GROUP BY node) n ON r.b = n.node
), method AS (
  SELECT node, CASE WHEN bool_or(rule_action = 'allow') THEN 'allow' ELSE 'block' END AS verdict FROM near GROUP BY node
), own AS (
  SELECT page_id, arg_max(h || p, length(h) + length(p)) AS rule, arg_max(a, length(h) + length(p)) AS action
  FROM (SELECT q.page_id, r.h, r.p, r.a FROM q JOIN rules r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)) GROUP BY page_id
)
SELECT q.page_id, q.host, q.path, own.rule, coalesce(own.action, m.verdict, 'allow') AS verdict
FROM q LEFT JOIN own USING (page_id) LEFT JOIN method m ON m.node = q.host || q.path
"""
}
