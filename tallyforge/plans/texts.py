"""Text features, similarity and scalar functions over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions import text as T
from ..operators import similarity
from ..sources.tables import table
from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


@R.add("x1_char_ngrams", """
SELECT item_id, len(list_distinct(CASE WHEN length(text) >= 5 THEN [substr(text, i, 5) for i in range(1, length(text) - 3)] ELSE [] END)) AS n FROM benchmark""")
def x1(spark, d) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.size(T.char_ngrams(F.col("text"))).cast("long").alias("n"))


_G = "WITH g AS (SELECT item_id, list_distinct(CASE WHEN length(text) >= 5 THEN [substr(text, i, 5) for i in range(1, length(text) - 3)] ELSE [] END) AS s FROM benchmark), j AS (SELECT a.item_id AS x, b.item_id AS y, len(list_intersect(a.s, b.s)) AS c, len(a.s) + len(b.s) AS t FROM g a JOIN g b ON a.item_id < b.item_id) "


@R.add("x2_jaccard_self_join", _G + "SELECT x, y, round(c / (t - c), 6) AS jaccard FROM j WHERE c / (t - c) >= 0.05")
def x2(spark, d) -> DataFrame:
    sets = similarity.gram_sets(table(spark, d, "benchmark"), "item_id", "text")
    return similarity.jaccard_pairs(sets, None, 0.05).select("x", "y", F.round("jaccard", 6).alias("jaccard"))


@R.add("x4_bigram_dice", """
WITH p AS (SELECT a.item_id, a.text AS x, b.text AS y FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1),
g AS (SELECT item_id, 0 AS side, unnest([substr(x, i, 2) for i in range(1, length(x))]) AS b FROM p UNION ALL SELECT item_id, 1, unnest([substr(y, i, 2) for i in range(1, length(y))]) FROM p),
c AS (SELECT item_id, b, least(count(*) FILTER (WHERE side = 0), count(*) FILTER (WHERE side = 1)) AS n FROM g GROUP BY 1, 2)
SELECT item_id, round(2.0 * (SELECT sum(n) FROM c WHERE c.item_id = p.item_id) / (length(x) + length(y) - 2), 6) AS dice FROM p""")
def x4(spark, d) -> DataFrame:
    b = table(spark, d, "benchmark")
    p = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")
    return p.select("item_id", F.round(T.dice(F.col("text"), F.col("other")), 6).alias("dice"))


@R.add("x6_normalised_names", "SELECT c_custkey, regexp_replace(replace(lower(replace(c_name, '#', '_')), '_', '-'), '^(customer-|cust-)', '') AS name FROM customer")
def x6(spark, d) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", T.normalised_name(F.replace("c_name", F.lit("#"), F.lit("_")), ("customer-", "cust-")).alias("name"))


@R.add("x7_terms", "SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]+'), lambda w: length(w) > 2)) AS n FROM documents")
def x7(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.size(T.terms(F.col("text"))).cast("long").alias("n"))


@R.add("x8_tf_idf", """
WITH f AS (SELECT item_id AS key, unnest(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]+'), lambda w: length(w) > 2)) AS term FROM benchmark), t AS (SELECT key, term, count(*) AS tf FROM f GROUP BY 1, 2),
i AS (SELECT term, ln((SELECT count(*) FROM benchmark) / count(*)) AS idf FROM t GROUP BY 1), w AS (SELECT key, term, (1 + ln(tf)) * idf AS w FROM t JOIN i USING (term) WHERE (1 + ln(tf)) * idf > 0)
SELECT key, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY key)), 6) AS w FROM w""")
def x8(spark, d) -> DataFrame:
    return similarity.tf_idf(table(spark, d, "benchmark"), "item_id", "text").select("key", "term", F.round("w", 6).alias("w"))


@R.add("x9_cosine_top_n", """
WITH f AS (SELECT item_id AS key, unnest(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9]+'), lambda w: length(w) > 2)) AS term FROM benchmark), t AS (SELECT key, term, count(*) AS tf FROM f GROUP BY 1, 2),
i AS (SELECT term, ln((SELECT count(*) FROM benchmark) / count(*)) AS idf FROM t GROUP BY 1), w0 AS (SELECT key, term, (1 + ln(tf)) * idf AS w FROM t JOIN i USING (term) WHERE (1 + ln(tf)) * idf > 0),
w AS (SELECT key, term, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS w FROM w0), s AS (SELECT a.key AS x, b.key AS y, sum(a.w * b.w) AS score FROM w a JOIN w b USING (term) WHERE a.key <> b.key GROUP BY 1, 2)
SELECT x, y, round(score, 6) AS score FROM s QUALIFY row_number() OVER (PARTITION BY x ORDER BY round(score, 9) DESC, y) <= 3""")
def x9(spark, d) -> DataFrame:
    w = similarity.tf_idf(table(spark, d, "benchmark"), "item_id", "text")
    dots = w.select(F.col("key").alias("x"), "term", F.col("w").alias("wx")).join(w.select(F.col("key").alias("y"), "term", F.col("w").alias("wy")), "term").where("x <> y")
    s = dots.groupBy("x", "y").agg(F.sum(F.col("wx") * F.col("wy")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc(F.round("score", 9)), "y"))
    return s.withColumn("r", rank).where("r <= 3").select("x", "y", F.round("score", 6).alias("score"))


@R.add("x10_normalised_commands", r"SELECT doc_id, left(regexp_replace(regexp_replace(lower(trim(text)), '\s+', ' ', 'g'), '[0-9]+', '0', 'g'), 300) AS command FROM documents")
def x10(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalised_command(F.col("text")).alias("command"))


@R.add("x13_command_keys", r"SELECT doc_id, regexp_extract(lower(text), '^\s*(\S+)(\s+[a-z]+)?', 1) || coalesce(regexp_extract(lower(text), '^\s*\S+(\s+[a-z]+)', 1), '') AS key FROM documents")
def x13(spark, d) -> DataFrame:
    low = F.lower("text")
    return table(spark, d, "documents").select("doc_id", F.concat(F.regexp_extract(low, r"^\s*(\S+)(\s+[a-z]+)?", 1), F.regexp_extract(low, r"^\s*\S+(\s+[a-z]+)", 1)).alias("key"))


@R.add("x18_terminal_view", """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)
SELECT doc_id, sha256(CASE WHEN len(s) > 4 THEN '[' || (len(s) - 4) || ' lines left out]' || chr(10) ELSE '' END || array_to_string([left(x, 50) for x in s[greatest(len(s) - 3, 1):]], chr(10))) AS view FROM l""")
def x18(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(T.terminal_view(F.col("text"), 4, 50).cast("binary"), 256).alias("view"))


@R.add("x21_output_trims", """
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)
SELECT doc_id, length(array_to_string(s[greatest(len(s) - 39, 1):], chr(10))) AS last40, length(array_to_string(s[1:40], chr(10))) AS first40,
  length(array_to_string(CASE WHEN len(s) <= 40 THEN s ELSE s[1:20] || s[len(s) - 19:] END, chr(10))) AS both FROM l""".replace("AS both", "AS both_ends"))
def x21(spark, d) -> DataFrame:
    n = lambda m: F.length(T.trimmed(F.col("text"), m)).cast("long")
    return table(spark, d, "documents").select("doc_id", n("last40").alias("last40"), n("first40").alias("first40"), n("first20last20").alias("both_ends"))


@R.add("x22_common_prefix_of_versions", """
WITH p AS (SELECT a.doc_id, string_split(a.text, '') AS x, string_split(b.text, '') AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1)
SELECT doc_id, coalesce(list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: x[i] <> y[i]), true) - 1, least(len(x), len(y))) AS prefix FROM p""")
def x22(spark, d) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", "text")
    p = t.join(t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")
    return p.select("doc_id", T.common_prefix(F.col("text"), F.col("other")).cast("long").alias("prefix"))


@R.add("x23_byte_lengths", "SELECT lang, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY 1")
def x23(spark, d) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.length("text")).alias("chars"))


@R.add("x33_hash_fraction", "SELECT doc_id, CAST('0x' || substr(sha256('3:' || doc_id), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents")
def x33(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", stats.hash_fraction(F.concat(F.lit("3:"), F.col("doc_id").cast("string"))).alias("u"))


@R.add("x34_hash_split", """
SELECT source, CASE WHEN u < 0.1 THEN 'development' WHEN u < 0.2 THEN 'temperature' ELSE 'train' END AS split FROM (
  SELECT DISTINCT source, CAST('0x' || substr(sha256('11:' || source), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents)""")
def x34(spark, d) -> DataFrame:
    u = stats.hash_fraction(F.concat(F.lit("11:"), "source"))
    return table(spark, d, "documents").select("source").distinct().select("source", F.when(u < 0.1, "development").when(u < 0.2, "temperature").otherwise("train").alias("split"))


@R.add("x35_group_keys", r"SELECT page_id, regexp_replace(split_part(url || '__' || page_id, '__', 1), '_run[0-9]+$', '') AS key FROM pages")
def x35(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.group_key(F.concat("url", F.lit("__"), F.col("page_id").cast("string"))).alias("key"))


@R.add("x36_row_ids", "SELECT concat_ws(':', l_orderkey, l_linenumber) AS id FROM lineitem")
def x36(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"))


@R.add("x37_token_estimates", "SELECT conv_id, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens FROM conversations GROUP BY 1")
def x37(spark, d) -> DataFrame:
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens"))


@R.add("x42_log_loss", """
SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 8) AS loss FROM (SELECT quality AS y, least(greatest(n_chars / 5000.0, 1e-6), 1 - 1e-6) AS p FROM labels JOIN documents USING (doc_id))""")
def x42(spark, d) -> DataFrame:
    p = F.least(F.greatest(F.col("n_chars") / 5000.0, F.lit(1e-6)), F.lit(1 - 1e-6))
    j = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("quality").alias("y"), p.alias("p"))
    return j.agg(F.round(F.avg(-(F.col("y") * F.log("p") + (1 - F.col("y")) * F.log(1 - F.col("p")))), 8).alias("loss"))


@R.add("x44_grep_files", "SELECT doc_id, pos AS line, x AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WHERE regexp_matches(x, '(?i)license')")
def x44(spark, d) -> DataFrame:
    rows = table(spark, d, "documents").where(F.rlike("text", F.lit("(?i)license"))).select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "text"))
    return rows.where(F.rlike("text", F.lit("(?i)license"))).select("doc_id", (F.col("p") + 1).cast("long").alias("line"), "text")


@R.add("x45_dates", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS utc_day, strftime(ts - INTERVAL 5 HOUR, '%Y-%m-%d') AS local_day, round(date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6, 3) AS seconds FROM events")
def x45(spark, d) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    start = F.unix_micros(F.lit("2024-01-01").cast("timestamp"))
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("utc_day"), F.date_format(F.expr("ts - interval 5 hours"), "yyyy-MM-dd").alias("local_day"), F.round((us - start) / 1e6, 3).alias("seconds"))


_CONTAM = "WITH b AS (SELECT item_id, list_distinct(CASE WHEN length(text) >= 5 THEN [substr(text, i, 5) for i in range(1, length(text) - 3)] ELSE [] END) AS s FROM benchmark), d AS (SELECT doc_id, list_distinct(CASE WHEN length(text) >= 5 THEN [substr(text, i, 5) for i in range(1, length(text) - 3)] ELSE [] END) AS s FROM documents) "


@R.add("j12_documents_against_benchmark", _CONTAM + ", j AS (SELECT item_id, doc_id, len(list_intersect(b.s, d.s)) AS c, len(b.s) + len(d.s) AS t FROM b, d) SELECT item_id, doc_id, round(c / (t - c), 6) AS jaccard FROM j WHERE c / (t - c) >= 0.4")
def j12(spark, d) -> DataFrame:
    a = similarity.gram_sets(table(spark, d, "benchmark"), "item_id", "text")
    b = similarity.gram_sets(table(spark, d, "documents"), "doc_id", "text")
    out = similarity.jaccard_pairs(a, b, 0.4)
    return out.select(F.col("x").alias("item_id"), F.col("y").alias("doc_id"), F.round("jaccard", 6).alias("jaccard"))


@R.add("page_titles_and_links", """
SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '(?i)<a href=')) AS links FROM pages""")
def page_titles(spark, d) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), F.regexp_count("html", F.lit("(?i)<a href=")).cast("long").alias("links"))
