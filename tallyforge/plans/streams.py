"""Scans, point reads and change feeds: the events table replayed as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import shared
from ..sources.tables import table
from ..streaming import documents, feeds, runaway, throttled
from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql


def replay(spark, d, run, commits: int = 3):
    """The events table as a stream of a few commits in the order of event_id. After each
    commit run(feed) takes in what is new, so commits are never mixed up, however many
    files one has; the last result of run is returned."""
    e = table(spark, d, "events")
    most = e.agg(F.max("event_id").alias("m")).first()["m"] or 0
    folder, out = shared(spark, "commits"), None
    for i in range(commits):
        e.where(F.floor(commits * F.col("event_id") / (most + 1)) == i).write.mode("append").parquet(folder)
        out = run(spark.readStream.schema(e.schema).parquet(folder))
    return out


def sink(feed: DataFrame, out: str) -> None:
    feed.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()


@R.add("s8_parquet_scan", "SELECT p_brand, count(*) AS n, round(sum(p_retailprice), 4) AS price FROM part WHERE p_size > 20 GROUP BY 1")
def s8(spark, d) -> DataFrame:
    return table(spark, d, "part").where("p_size > 20").groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 4).alias("price"))


@R.add("s20_point_read", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def s20(spark, d) -> DataFrame:
    return table(spark, d, "customer").where("c_custkey = 42").limit(1).select("c_custkey", "c_name")


@R.add("s21_secondary_key", "SELECT conv_id, turn, role FROM conversations WHERE conv_id = 3 AND turn = 1")
def s21(spark, d) -> DataFrame:
    return table(spark, d, "conversations").where("conv_id = 3 and turn = 1").select("conv_id", "turn", "role")


@R.add("t2_feed_counts", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1")
def t2(spark, d) -> DataFrame:
    """Stateless appends of the feed, summed afterwards."""
    out = shared(spark, "feed")
    replay(spark, d, lambda feed: sink(feed.select("event_id", "event_type", "value"), out))
    return spark.read.parquet(f"{out}/rows").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@R.add("t4_latest_view", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def t4(spark, d) -> DataFrame:
    """A view per key, folded batch by batch; a batch rewrites only the shards it touches."""
    out = shared(spark, "view")
    return replay(spark, d, lambda feed: feeds.latest_view(spark, feed.select("user_id", "event_id", "event_type"), f"{out}/view", "user_id", "event_id", f"{out}/state"))


@R.add("t9_idempotent_requests", "SELECT user_id, event_type, min(event_id) AS event_id, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2")
def t9(spark, d) -> DataFrame:
    """The first row of each request id, as the feed delivered it."""
    _stateful(spark)
    out = shared(spark, "once")
    return replay(spark, d, lambda feed: feeds.first_per_request(spark, feed.select("user_id", "event_type", "event_id", "value"), f"{out}/rows", ["user_id", "event_type"], "event_id", f"{out}/state"))


@R.add("t3_bounded_watch", """
WITH b AS (SELECT *, 2 * event_id // (SELECT max(event_id) + 1 FROM events) AS batch FROM events), n AS (SELECT *, count(*) OVER (PARTITION BY user_id, batch) AS n, max(event_id) OVER (PARTITION BY user_id, batch) AS newest FROM b)
SELECT user_id, event_id, CASE WHEN n > 4 THEN n ELSE 1 END AS frames FROM n WHERE n <= 4 OR event_id = newest""")
def t3(spark, d) -> DataFrame:
    """Users with more than four pending frames in one of two batches get one replacement."""
    out = shared(spark, "watch")
    return replay(spark, d, lambda feed: feeds.bounded_frames(spark, feed.select("user_id", "event_id"), f"{out}/rows", "user_id", "event_id", 4, f"{out}/state"), 2)


@R.add("t6_translated_events", """
SELECT event_id, unnest(CASE event_type WHEN 'signup' THEN ['session_start', 'status'] WHEN 'error' THEN ['status'] WHEN 'purchase' THEN ['message_start', 'message_end', 'status'] ELSE ['update'] END) AS name FROM events""")
def t6(spark, d) -> DataFrame:
    """Each change becomes one or more events of an interface, without state."""
    t = F.col("event_type")
    names = lambda *n: F.array(*map(F.lit, n))
    made = F.when(t == "signup", names("session_start", "status")).when(t == "error", names("status")).when(t == "purchase", names("message_start", "message_end", "status")).otherwise(names("update"))
    out = shared(spark, "translated")
    replay(spark, d, lambda feed: sink(feed.select("event_id", F.explode(made).alias("name")), out))
    return spark.read.parquet(f"{out}/rows")


def _stateful(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@R.add("t7_loop_guard", """
WITH o AS (SELECT user_id, event_id, event_type, row_number() OVER w AS i, count(*) FILTER (WHERE event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seg FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT CAST(a.user_id AS VARCHAR) AS session, a.event_id AS seq, min(a.i - b.i) AS distance FROM o a JOIN o b ON a.user_id = b.user_id AND a.seg = b.seg AND a.event_type = b.event_type AND b.i < a.i AND a.i - b.i <= 6 WHERE a.event_type <> 'purchase' GROUP BY ALL""")
def t7(spark, d) -> DataFrame:
    """Repeats among the last six actions of a live stream, with state per session."""
    _stateful(spark)
    out = shared(spark, "guard")
    actions = (F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq"), F.col("event_type").alias("action"), (F.col("event_type") == "purchase").alias("changes"))
    replay(spark, d, lambda feed: sink(feeds.loop_guard(feed.select(*actions)), out))
    return spark.read.schema("session string, seq long, distance long").parquet(f"{out}/rows")


def streamed_texts(spark, d) -> DataFrame:
    """(key, seq, chunk): the documents in chunks of 300 characters, some with an end that runs away."""
    i = F.col("doc_id")
    piece = F.repeat(F.right(F.concat(F.lit("0123456789abcdefghijklmnopqrstuvwxyz"), i.cast("string")), F.lit(30)), F.lit(20))
    line = F.repeat(F.concat(F.lit("\n  a line that comes again "), i.cast("string"), F.lit("\n}")), (6 + i % 3).cast("int"))
    text = F.concat(F.coalesce("text", F.lit("")), F.when(i % 7 == 0, piece).when(i % 11 < 4, line).otherwise(""))
    rows = table(spark, d, "documents").select("doc_id", text.alias("text"))
    seq = F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 300).cast("int")))
    return rows.select(i.cast("string").alias("key"), seq.alias("seq"), "text").select("key", F.col("seq").cast("long").alias("seq"), F.substr("text", (F.col("seq") * 300 + 1).cast("int"), F.lit(300)).alias("chunk"))


@R.add("t7_runaway_cut")
def t7_cut(spark, d) -> DataFrame:
    """Texts cut where they run away, with state per text; from 500 characters on, as few
    documents have 20,000 (no SQL twin: tested against whole texts)."""
    _stateful(spark)
    folder, out = shared(spark, "chunks"), shared(spark, "cuts")
    rows = streamed_texts(spark, d)
    for part in ("seq < 3", "seq between 3 and 9", "seq > 9"):
        rows.where(part).write.mode("append").parquet(folder)
        sink(runaway.runaways(spark.readStream.schema(rows.schema).parquet(folder), runaway.Limits(least=500)), out)
    return spark.read.schema(runaway.RUNAWAY).parquet(f"{out}/rows")


@R.add("t8_tailed_labels", "SELECT doc_id, toxic FROM labels")
def t8(spark, d) -> DataFrame:
    """Lines appended since the last read: a second run of the same query reads only new files."""
    folder, out = shared(spark, "labels"), shared(spark, "tailed")
    l = table(spark, d, "labels").select("doc_id", "toxic")
    for part in ("doc_id % 2 = 0", "doc_id % 2 = 1"):
        l.where(part).write.mode("append").json(folder)
        sink(feeds.change_feed(spark, folder, "doc_id long, toxic int", 100), out)
    return spark.read.schema("doc_id long, toxic int").parquet(f"{out}/rows")


@R.add("t10_resumed_by_done_ids", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'first run' ELSE 'second run' END AS made FROM labels")
def t10(spark, d) -> DataFrame:
    """A job that was broken off goes on with the ids that its output lacks."""
    out = shared(spark, "resumed")
    l = table(spark, d, "labels").select("doc_id")
    l.where("doc_id % 3 = 0").withColumn("made", F.lit("first run")).write.parquet(out)
    left = l.join(spark.read.parquet(out).select("doc_id"), "doc_id", "left_anti")
    left.withColumn("made", F.lit("second run")).write.mode("append").parquet(out)
    return spark.read.schema("doc_id long, made string").parquet(out)


@R.add("t11_throttled_commits", """
WITH RECURSIVE e AS (SELECT user_id, event_type AS value, epoch_us(ts) // 1000 AS tm, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT user_id, i, tm, value, tm AS committed, NULL::VARCHAR AS waits, NULL::BIGINT AS due_at, NULL::VARCHAR AS due, tm AS now_at, value AS now FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.i, e.tm, e.value, CASE WHEN e.tm >= b.base + 21600000 THEN e.tm ELSE b.base END, CASE WHEN e.tm >= b.base + 21600000 THEN NULL ELSE e.value END, b.due_at, b.due, CASE WHEN e.tm >= b.base + 21600000 THEN e.tm END, CASE WHEN e.tm >= b.base + 21600000 THEN e.value END
  FROM (SELECT w.user_id, w.i, n.tm AS next_at, CASE WHEN w.waits IS NOT NULL AND w.committed + 21600000 <= n.tm THEN w.committed + 21600000 ELSE w.committed END AS base, CASE WHEN w.waits IS NOT NULL AND w.committed + 21600000 <= n.tm THEN w.committed + 21600000 END AS due_at,
    CASE WHEN w.waits IS NOT NULL AND w.committed + 21600000 <= n.tm THEN w.waits END AS due FROM w JOIN e n ON n.user_id = w.user_id AND n.i = w.i + 1) b JOIN e ON e.user_id = b.user_id AND e.i = b.i + 1)
SELECT CAST(user_id AS VARCHAR) AS key, due_at AS at_ms, due AS value FROM w WHERE due_at IS NOT NULL UNION ALL SELECT CAST(user_id AS VARCHAR), now_at, now FROM w WHERE now_at IS NOT NULL""")
def t11(spark, d) -> DataFrame:
    """At most one commit in six hours a user; what waits when the feed ends stays uncommitted,
    since no time passes after it (the watermark stays far behind)."""
    _stateful(spark)
    out = shared(spark, "throttled")
    rows = lambda feed: feed.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("value"), F.lit(False).alias("final"))
    replay(spark, d, lambda feed: sink(throttled.throttled(rows(feed), 21_600_000, "3650 days"), out))
    return spark.read.schema(throttled.COMMITS).parquet(f"{out}/rows").select("key", "at_ms", "value")


@R.add("t12_head_and_tail_buffers", """
WITH o AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT CAST(user_id AS VARCHAR) AS session, max(n) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (WHERE i <= 3) AS head, coalesce(string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) FILTER (WHERE i > 3 AND n - i < 3), '') AS tail, greatest(max(n) - 6, 0) AS left_out FROM o GROUP BY 1""")
def t12(spark, d) -> DataFrame:
    """First and last three outputs of each session; the last state of each buffer."""
    _stateful(spark)
    out = shared(spark, "buffers")
    rows = lambda feed: feeds.head_and_tail(feed.select(F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("seq")))
    kinds = "session string, n long, head string, tail string, left_out long"
    replay(spark, d, lambda feed: feeds.each_batch(rows(feed), lambda b, i: b.write.mode("overwrite").parquet(f"{out}/rows/v{i}"), f"{out}/state", "update"))
    rows = spark.read.schema(kinds).option("recursiveFileLookup", True).parquet(f"{out}/rows")
    return rows.groupBy("session").agg(F.max_by(F.struct("n", "head", "tail", "left_out"), "n").alias("b")).select("session", "b.*")


@R.add("t13_starts_in_last_hour", "SELECT event_id, count(*) OVER (ORDER BY epoch_us(ts) / 1e6 RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_hour FROM events")
def t13(spark, d) -> DataFrame:
    return feeds.starts_in_last_hour(table(spark, d, "events").select("event_id", "ts"), "ts").select("event_id", "in_hour")


_VERSIONS = tuple(
    documents.Definition(v, initial=lambda: {"k": 0}, migrate=lambda value, old: value | {"since": old}, checkpoint_when=lambda value, ops, n: n >= 4) for v in (1, 2)
)


@R.add("p7_checkpointed_documents", """
WITH e AS (SELECT user_id AS document_id, event_id AS seq, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS t, 3 * event_id // (SELECT max(event_id) + 1 FROM events) >= 2 AS late FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY document_id, late ORDER BY seq) - 1 AS i, count(*) FILTER (WHERE NOT late) OVER (PARTITION BY document_id) > 0 AS old FROM e)
SELECT document_id, seq, CASE WHEN i % 5 = 0 THEN 'base' ELSE 'delta' END AS kind, CAST(CASE WHEN late THEN 2 ELSE 1 END AS INTEGER) AS version,
  CASE WHEN i % 5 = 0 THEN '{"k": ' || k || ', "last": "' || t || '"' || CASE WHEN late AND old THEN ', "since": 1' ELSE '' END || '}' ELSE '[["s", ["k"], ' || k || '], ["s", ["last"], "' || t || '"]]' END AS content FROM n""")
def p7(spark, d) -> DataFrame:
    """Documents of users: a base after four deltas at most, and one when the second version of the definition takes over."""
    _stateful(spark)
    out, calls = shared(spark, "documents"), iter(range(100))
    k = F.get_json_object("props", "$.k")
    ops = F.format_string('[["s", ["k"], %s], ["s", ["last"], "%s"]]', k, F.col("event_type"))
    changes = lambda feed: feed.select(F.col("user_id").alias("document_id"), F.col("event_id").alias("seq"), ops.alias("ops"))
    replay(spark, d, lambda feed: sink(documents.revisions(changes(feed), _VERSIONS[next(calls) >= 2]), out))
    return spark.read.schema(documents.REVISIONS).parquet(f"{out}/rows")
