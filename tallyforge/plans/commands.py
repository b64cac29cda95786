"""Commands, outputs, JSON and search: functions of one text, on command lines and texts
made from the driver's tables. The SQL names what each template must give."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import python_udfs as U
from ..functions import search
from ..functions import text as T
from ..functions.edits import applied_edits
from ..operators import deltas, errors, similarity
from ..sources.tables import table
from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

_K = "CAST(json_extract(props, '$.k') AS BIGINT)"

def _sql(v) -> str:
    return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)


def values(rows: tuple, names: str) -> str:
    """A SQL table of literal rows, numbered from 0 in column i."""
    return "(VALUES " + ", ".join(f"({i}, {', '.join(map(_sql, r))})" for i, r in enumerate(rows)) + f") t(i, {names})"


_E = f"WITH e AS (SELECT event_id, {_K} AS k FROM events) "


def filled(templates: tuple, k: F.Column) -> F.Column:
    """The template number k mod their number, with k put in."""
    return F.replace(F.get(F.array(*map(F.lit, templates)), (k % len(templates)).cast("int")), F.lit("{k}"), k.cast("string"))


def keyed(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


#: Output, command, exit code (-1: none) -> class and detail. The ladder's first match wins.
OUTPUTS = (
    ("Validation failed for tool bash", "ls", -1, "malformed", None), ("Command timed out after {k} s", "make", -1, "timeout or killed", None), ("x\nKilled", "make", -1, "timeout or killed", None), ("no output", "make", 137, "timeout or killed", None),
    ("bash: line 1: python: command not found", "python x.py", 127, "interpreter", None), ("/usr/bin/env: ‘node’: No such file or directory", "./a.js", 127, "interpreter", None), ("bash: jq: command not found", "jq . f", 127, "program", "jq"), ("sh: 1: xxd{k}: not found", "xxd{k} f", 127, "program", "xxd{k}"),
    ("ModuleNotFoundError: No module named 'x{k}'", "python x.py", 1, "module", None), ("a.c:1:10: fatal error: zlib.h: No such file or directory", "gcc a.c", 1, "module", None), ("/usr/bin/ld: cannot find -lm{k}", "gcc a.c", 1, "module", None),
    ("cp: cannot create f: Permission denied", "cp a f", 1, "permission", None), ("bash: ./run{k}.sh: Permission denied", "./run{k}.sh --now", 126, "no execute permission", "./run{k}.sh"),
    ("curl: (7) Failed to connect to localhost port {k}: Connection refused", "curl localhost:{k}", 7, "local server", None), ("curl: (6) Could not resolve host: a{k}", "curl a", 6, "network", None), ("ping: h{k}: Name or service not known", "ping h", 2, "network", None), ("wget: ERROR 404: missing", "wget a", 8, "network", None),
    ("E: Unable to locate package p{k}", "apt-get install p", 100, "install", None), ("E: Package p{k} has no installation candidate", "apt install p", 100, "install", None),
    ("  File x\nSyntaxError: invalid syntax", "python x.py", 1, "syntax", None), ("main.c:{k}:1: error: expected ;", "gcc main.c", 1, "syntax", None), ("error[E0308]: mismatched types", "cargo build", 101, "syntax", None), ("sed: -e expression #1, char 5: unterminated `s' command", "sed s/a f", 1, "syntax", None),
    ("fatal: not a git repository", "git status", 128, "git", None), ("fatal: not seen by git", "make", 2, "no error text", None),
    ("cat: f{k}: No such file or directory", "cat f", 1, "missing path", "f{k}"), ("ls: cannot access 'd{k}/': No such file or directory", "ls d", 2, "missing path", "d{k}"), ("Traceback (most recent call last):\nFileNotFoundError: [Errno 2] No such file or directory: 'f{k}'", "python x.py", 1, "missing path", "f{k}"),
    ("bash: out{k}/a.txt: No such file or directory", "echo 1 > out{k}/a.txt", 1, "missing folder", "out{k}/a.txt"), ("bash: line 3: cd: w{k}: No such file or directory", "cd w{k}", 1, "missing folder", "w{k}"), ("cp: cannot create regular file 'z{k}/f': No such file or directory", "cp f z", 1, "missing folder", "z{k}/f"),
    ("== {k}7 failed, 2 passed ==", "pytest", 1, "tests", None), ("Traceback (most recent call last):\nAssertionError: {k}", "python x.py", 1, "tests", "AssertionError"), ("no words", "python -m pytest -q", 1, "tests", None),
    ("Traceback (most recent call last):\nValueError: No such file or directory", "python x.py", 1, "exception", "ValueError"), ("terminate called after throwing an instance of 'int'", "./a.out", 134, "exception", None), ("no output", "./a.out", 139, "exception", None),
    ("no output", "cd a; grep x f", 1, "nothing found", None), ("no output", "frobnicate {k}", 1, "no error text", None), ("", "diff a b", 1, "nothing found", None),
)


@R.add("x12_error_classes", _E + f"SELECT event_id, class, replace(detail, '{{k}}', CAST(k AS VARCHAR)) AS detail FROM e JOIN {values(OUTPUTS, 'output, command, code, class, detail')} ON k % {len(OUTPUTS)} = i")
def x12(spark, d) -> DataFrame:
    """Failed calls by class, each a session of its own."""
    k = F.col("k")
    e = keyed(spark, d).select("event_id", filled(tuple(o[0] for o in OUTPUTS), k).alias("output"), filled(tuple(o[1] for o in OUTPUTS), k).alias("command"), F.nullif(F.get(F.array(*[F.lit(o[2]) for o in OUTPUTS]), (k % len(OUTPUTS)).cast("int")), F.lit(-1)).alias("code"))
    got = errors.classified(e.withColumn("turn", F.lit(0)), ["event_id"], "turn")
    return got.select("event_id", "class", "detail")


@R.add("x12_wrong_paths", """
WITH c AS (SELECT conv_id, turn, turn % 2 = 0 AS shows, (conv_id + turn) % 3 AS k, (conv_id * 3 + turn) % 4 AS form FROM conversations),
s AS (SELECT conv_id, k, turn AS at, CASE form WHEN 0 THEN 'deep' WHEN 1 THEN 'bare' WHEN 2 THEN 'short' ELSE 'other' END AS how FROM c WHERE shows),
m AS (SELECT conv_id, turn, k, form, CASE form WHEN 0 THEN 'lib/part' || k || '.py' WHEN 1 THEN 'part' || k || '.py' WHEN 2 THEN 'old/main.py' ELSE '/app/src/part' || k || '.py' END AS path FROM c WHERE NOT shows)
SELECT m.conv_id, m.turn, path AS detail, CASE WHEN bool_or(CASE form WHEN 0 THEN how IN ('deep', 'bare', 'short') WHEN 1 THEN how IN ('deep', 'short') WHEN 2 THEN FALSE ELSE how = 'deep' OR how = 'bare' END) THEN 'wrong path' ELSE 'missing path' END AS class
FROM m LEFT JOIN s ON s.conv_id = m.conv_id AND s.k = m.k AND s.at < m.turn GROUP BY m.conv_id, m.turn, path""")
def x12_wrong(spark, d) -> DataFrame:
    """Sessions whose even turns show paths and whose odd turns miss one: had it been shown elsewhere?"""
    c, t = F.col("conv_id"), F.col("turn")
    k, form = ((c + t) % 3).cast("string"), (c * 3 + t) % 4
    put = lambda *texts: F.replace(F.when(form == 0, texts[0]).when(form == 1, texts[1]).when(form == 2, texts[2]).otherwise(texts[3]), F.lit("{k}"), k)
    shows = put("found: ./pkg/core/part{k}.py and main.py\n", "total 8\npart{k}.py\nnotes.md", "src/part{k}.py:12: x", "part{k}.pyc mypart{k}.py")
    misses = put("cat: lib/part{k}.py: No such file or directory", "python: can't open file 'part{k}.py': [Errno 2] No such file or directory", "cat: old/main.py: No such file or directory", "cat: /app/src/part{k}.py: No such file or directory")
    calls = table(spark, d, "conversations").select("conv_id", "turn", F.lit("cat x").alias("command"), F.when(t % 2 == 0, shows).otherwise(misses).alias("output"), (t % 2).cast("int").alias("code"))
    return errors.classified(calls, ["conv_id"], "turn").where("turn % 2 = 1").select("conv_id", "turn", "class", "detail")


#: Test output -> passed, failed (null: no counts).
TESTS = (
    ("== {k} failed, 5 passed in 3s ==", "k", 5), ("5 passed, 2 warnings", 0, 5), ("Ran 9 tests in 1s\n\nOK", 0, 9), ("Ran 9 tests\n\nFAILED (failures=1, errors=2)", 3, 6), ("no tests here", None, None),
    ("1 failed, 2 passed, 3 errors in 1s", 4, 2), ("4 passed\n== {k} failed, 7 passed, 1 error ==", "k + 1", 7), ("Ran 3 tests\nFAILED (errors=1)\nRan 8 tests\nFAILED (failures=2)", 2, 6),
)


@R.add("x11_test_counts", _E + """
SELECT event_id, CASE k % 8 WHEN 0 THEN 5 WHEN 1 THEN 5 WHEN 2 THEN 9 WHEN 3 THEN 6 WHEN 5 THEN 2 WHEN 6 THEN 7 WHEN 7 THEN 6 END AS passed, CASE k % 8 WHEN 0 THEN k WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 3 WHEN 5 THEN 4 WHEN 6 THEN k + 1 WHEN 7 THEN 2 END AS failed FROM e""")
def x11(spark, d) -> DataFrame:
    e = keyed(spark, d).select("event_id", T.test_counts(filled(tuple(t[0] for t in TESTS), F.col("k"))).alias("t"))
    return e.select("event_id", "t.passed", F.col("t.failed").cast("long").alias("failed"))


@R.add("x3_sequence_ratio")
def x3(spark, d) -> DataFrame:
    """Matching-block ratio of neighbouring benchmark texts (no SQL twin: tested against difflib)."""
    b = table(spark, d, "benchmark")
    p = b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")
    return p.select("item_id", F.round(U.sequence_ratio("text", "other"), 6).alias("ratio"))


@R.add("x3_similar_pairs")
def x3_pairs(spark, d) -> DataFrame:
    """All pairs of benchmark texts, and of copies without every seventh word, with a sequence
    ratio of 0.6 at least, through the gates (no SQL twin: tested against all pairs)."""
    b = table(spark, d, "benchmark").select("item_id", "text")
    copies = b.select((F.col("item_id") + 1_000_000).alias("item_id"), F.regexp_replace("text", r"((?:\S+\s+){6})\S+\s+", "$1").alias("text"))
    return similarity.ratio_pairs(b.unionByName(copies), "item_id", "text", 0.6).select("x", "y", F.round("ratio", 6).alias("ratio"))


@R.add("x5_near_identical", """
WITH p AS (SELECT item_id, left(text, 10 + item_id) AS x, left(text, 10 + item_id) || repeat('?', item_id % 17) AS y FROM benchmark),
g AS (SELECT item_id, 0 AS side, unnest([substr(x, i, 2) for i in range(1, length(x))]) AS b FROM p UNION ALL SELECT item_id, 1, unnest([substr(y, i, 2) for i in range(1, length(y))]) FROM p),
c AS (SELECT item_id, CAST(sum(n) AS DOUBLE) AS n FROM (SELECT item_id, b, least(count(*) FILTER (WHERE side = 0), count(*) FILTER (WHERE side = 1)) AS n FROM g GROUP BY 1, 2) GROUP BY 1)
SELECT item_id, x = y OR (least(length(x), length(y)) >= 20 AND least(length(x), length(y)) >= 0.8 * greatest(length(x), length(y)) AND 2 * n / (length(x) + length(y) - 2) >= 0.9) AS same FROM p JOIN c USING (item_id)""")
def x5(spark, d) -> DataFrame:
    x = F.left("text", (10 + F.col("item_id")).cast("int"))
    p = table(spark, d, "benchmark").select("item_id", x.alias("x"), F.concat(x, F.repeat(F.lit("?"), (F.col("item_id") % 17).cast("int"))).alias("y"))
    return p.select("item_id", T.near_identical(F.col("x"), F.col("y")).alias("same"))


@R.add("u5_gram_set_operations", """
WITH g AS (SELECT item_id, list_distinct(CASE WHEN length(text) >= 5 THEN [substr(text, i, 5) for i in range(1, length(text) - 3)] ELSE [] END) AS s FROM benchmark)
SELECT a.item_id, len(list_intersect(a.s, b.s)) AS shared, len(list_distinct(a.s || b.s)) AS either FROM g a JOIN g b ON b.item_id = a.item_id + 1""")
def u5(spark, d) -> DataFrame:
    g = table(spark, d, "benchmark").select("item_id", T.char_ngrams(F.col("text")).alias("s"))
    p = g.join(g.select((F.col("item_id") - 1).alias("item_id"), F.col("s").alias("o")), "item_id")
    return p.select("item_id", F.size(F.array_intersect("s", "o")).cast("long").alias("shared"), F.size(F.array_union("s", "o")).cast("long").alias("either"))


@R.add("j11_theta_self_join", """
WITH g AS (SELECT item_id, list_distinct(CASE WHEN length(text) >= 5 THEN [substr(text, i, 5) for i in range(1, length(text) - 3)] ELSE [] END) AS s FROM benchmark),
j AS (SELECT a.item_id AS x, b.item_id AS y, len(list_intersect(a.s, b.s)) AS c, len(a.s) + len(b.s) AS t FROM g a JOIN g b ON a.item_id < b.item_id WHERE (a.item_id % 3 = 0 OR b.item_id % 3 = 0) AND a.item_id % 5 <> b.item_id % 5)
SELECT x, y, round(c / (t - c), 6) AS jaccard FROM j WHERE c / (t - c) >= 0.1""")
def j11(spark, d) -> DataFrame:
    """Similar pairs of which one at least is new (item_id mod 3 = 0) and that are not of one set (mod 5)."""
    pairs = similarity.jaccard_pairs(similarity.gram_sets(table(spark, d, "benchmark"), "item_id", "text"), None, 0.1)
    return pairs.where("(x % 3 = 0 or y % 3 = 0) and x % 5 <> y % 5").select("x", "y", F.round("jaccard", 6).alias("jaccard"))


@R.add("x19_truncated_by_lines_and_bytes", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents),
h AS (SELECT *, sum(strlen(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS up, sum(strlen(x) + 1) OVER (PARTITION BY doc_id ORDER BY i DESC) - 1 AS down FROM l)
SELECT doc_id, count(*) FILTER (WHERE i <= 12 AND up <= 900) AS head_lines, coalesce(max(up) FILTER (WHERE i <= 12 AND up <= 900), 0) AS head_bytes, count(*) FILTER (WHERE n - i < 12 AND down <= 900) AS tail_lines,
  CASE WHEN max(n) <= 12 AND max(up) <= 900 THEN 'whole' WHEN min(up) FILTER (WHERE i <= 12) > 900 OR coalesce(max(up) FILTER (WHERE i <= 12), 0) > 900 THEN 'bytes' ELSE 'lines' END AS cut_by FROM h GROUP BY 1""".replace("min(up) FILTER (WHERE i <= 12) > 900 OR ", ""))
def x19(spark, d) -> DataFrame:
    """Whole lines from either end under limits of lines and UTF-8 bytes."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", T.head_by_lines_and_bytes(F.col("text"), 12, 900).alias("h"), T.tail_by_lines_and_bytes(F.col("text"), 12, 900).alias("t"))
    return t.select("doc_id", F.col("h.lines").alias("head_lines"), F.col("h.bytes").alias("head_bytes"), F.col("t.lines").alias("tail_lines"), F.col("h.cut_by").alias("cut_by"))


@R.add("x20_fitted_to_a_token_limit", """
WITH l AS (SELECT doc_id, length(text) AS whole, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i, len(string_split(text, chr(10))) AS n FROM documents),
h AS (SELECT *, CAST(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - 1 AS up, CAST(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i DESC) AS BIGINT) AS down FROM l),
b AS (SELECT doc_id, max(whole) AS whole, max(n) AS n, count(*) FILTER (WHERE ceil(up / 4.0) <= 60) AS head, coalesce(max(up) FILTER (WHERE ceil(up / 4.0) <= 60), -1) AS used FROM h GROUP BY 1),
c AS (SELECT h.doc_id, b.whole, b.head, b.n, h.n - h.i + 1 AS tail, b.used + 1 + length('[... ' || (b.n - b.head - (h.n - h.i + 1)) || CASE WHEN b.n - b.head - (h.n - h.i + 1) = 1 THEN ' line' ELSE ' lines' END || ' left out ...]') + h.down AS chars FROM h JOIN b USING (doc_id) WHERE h.i > b.head)
SELECT doc_id, max(head) AS head, max(tail) FILTER (WHERE ceil(chars / 4.0) <= 200) AS tail FROM (SELECT doc_id, whole, head, n, tail, chars FROM c UNION ALL SELECT doc_id, whole, head, n, 0, 0 FROM b) WHERE ceil(whole / 4.0) > 200 GROUP BY 1""")
def x20(spark, d) -> DataFrame:
    """Head lines within a budget, then as many end lines as the limit leaves; the counter of
    tokens is a function that is passed in."""
    return _fitted(spark, d)


def estimate(text: str) -> int:
    return -(-len(text) // 4)


def _fitted(spark, d) -> DataFrame:
    fit = U.fitted_lines(estimate, 200, 60)
    t = table(spark, d, "documents").where("text is not null").select("doc_id", fit("text").alias("f"))
    return t.where("f.head is not null").select("doc_id", F.col("f.head").cast("long").alias("head"), F.col("f.tail").cast("long").alias("tail"))


@R.add("p6_injected_token_counter", "SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL")
def p6(spark, d) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", U.counted(estimate)("text").alias("tokens"))


# JSON


@R.add("x27_repaired_json", """
WITH e AS (SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, event_id % 7 AS cut FROM events)
SELECT event_id, CASE cut WHEN 0 THEN '{"k": ' || k || '}' WHEN 1 THEN '{}' WHEN 2 THEN '{"": null}' WHEN 3 THEN '{"k": null}' WHEN 4 THEN '{"k": null}' WHEN 5 THEN '{"k": null}' ELSE '{"k": ' || left(k, 1) || '}' END AS json FROM e""")
def x27(spark, d) -> DataFrame:
    """Props cut off after 1 to 7 characters, closed again."""
    e = table(spark, d, "events").select("event_id", "props", (F.col("event_id") % 7).alias("cut"))
    n = F.get(F.array(*map(F.lit, (100, 1, 2, 3, 4, 5, 7))), F.col("cut").cast("int"))
    return e.select("event_id", U.repaired_json(F.left("props", n)).alias("json"))


@R.add("x32_canonical_json", f"""SELECT event_id, '{{"a":[' || {_K} || ',2],"b":"x y","c":{{"d":null,"e":true}}}}' AS json FROM events""")
def x32(spark, d) -> DataFrame:
    raw = F.concat(F.lit('{ "c": {"e": true, "d": null}, "b": " x \\t y",  "a": ['), F.col("k").cast("string"), F.lit(", 2]}"))
    return keyed(spark, d).select("event_id", U.canonical_json(raw).alias("json"))


@R.add("x30_overlap", """
WITH p AS (SELECT item_id, left(text, 30 + item_id) AS a, substr(text, 11, 60) AS b FROM benchmark)
SELECT item_id, coalesce(list_max([i for i in range(1, least(length(a), length(b)) + 1) if right(a, i) = left(b, i)]), 0) AS n FROM p""")
def x30(spark, d) -> DataFrame:
    t = table(spark, d, "benchmark").select("item_id", F.left("text", (30 + F.col("item_id")).cast("int")).alias("a"), F.substring("text", 11, 60).alias("b"))
    return t.select("item_id", U.overlap("a", "b").cast("long").alias("n"))


PATHS = (("/a/b", "../c/./d", "/a/c/d"), ("/a/b", "/x//y/..", "/x"), ("/", "e{k}", "/e{k}"), ("/a", ".", "/a"), ("/a/b", "../../../f{k}", "/f{k}"))


@R.add("x38_resolved_paths", _E + f"SELECT event_id, replace(want, '{{k}}', CAST(k AS VARCHAR)) AS path FROM e JOIN {values(PATHS, 'folder, given, want')} ON k % {len(PATHS)} = i")
def x38(spark, d) -> DataFrame:
    k = F.col("k")
    e = keyed(spark, d).select("event_id", filled(tuple(p[0] for p in PATHS), k).alias("folder"), filled(tuple(p[1] for p in PATHS), k).alias("given"))
    return e.select("event_id", U.resolved_path("folder", "given").alias("path"))


@R.add("x41_sizes_in_mb", _E + "SELECT event_id, CASE k % 6 WHEN 0 THEN k * 1024.0 WHEN 1 THEN k WHEN 2 THEN k * 1048576.0 WHEN 3 THEN k / 1024.0 WHEN 4 THEN k / 1048576.0 END AS mb FROM e".replace("WHEN 1 THEN k WHEN", "WHEN 1 THEN k * 1.0 WHEN").replace("/ 1024.0", "/ 1024.0::DOUBLE").replace("/ 1048576.0", "/ 1048576.0::DOUBLE").replace("k * ", "k::DOUBLE * "))
def x41(spark, d) -> DataFrame:
    unit = filled(("G", "M", "T", "K", "", " parsecs"), F.col("k"))
    return keyed(spark, d).select("event_id", T.size_to_mb(F.concat(F.col("k").cast("string"), unit)).alias("mb"))


@R.add("x43_unified_diff", _E + "SELECT event_id, '--- ' || chr(10) || '+++ ' || chr(10) || '@@ -1,3 +1,3 @@' || chr(10) || ' first' || chr(10) || '-line ' || k || chr(10) || '+line ' || (k + 1) || chr(10) || ' last' AS diff FROM e")
def x43(spark, d) -> DataFrame:
    text = lambda k: F.concat(F.lit("first\nline "), k.cast("string"), F.lit("\nlast"))
    return keyed(spark, d).select("event_id", U.unified_diff(text(F.col("k")), text(F.col("k") + 1)).alias("diff"))


@R.add("x40_image_of_a_build_file", """
SELECT p_partkey, p_brand || ':' || p_size AS base, sha256('FROM ' || p_brand || ':' || p_size || chr(10) || 'RUN apt-get install ' || p_type || chr(10) || 'WORKDIR /app') AS prefix FROM part""")
def x40(spark, d) -> DataFrame:
    """Base image of a build file and a hash of its lines before the first COPY or ADD."""
    p = table(spark, d, "part")
    text = F.concat(F.lit("# built\nFROM "), "p_brand", F.lit(":"), F.col("p_size").cast("string"), F.lit(" AS base\n\nRUN apt-get install "), "p_type", F.lit("\nWORKDIR /app\nCOPY . /app\nRUN make"))
    return p.select("p_partkey", T.base_image(text).alias("base"), T.build_prefix_hash(text).alias("prefix"))


# base and deltas

_REVISIONS = """
WITH e AS (SELECT user_id, event_id, event_type, {k} AS k FROM events {where}), b AS (SELECT user_id, max(event_id) AS base FROM e WHERE event_type = 'signup' GROUP BY 1),
t AS (SELECT e.*, base FROM e JOIN b USING (user_id) WHERE event_id >= base)
SELECT user_id AS document_id, '{{' || CASE WHEN count(*) FILTER (WHERE event_type = 'purchase') > 0 THEN '"at": ' || max(event_id) FILTER (WHERE event_type = 'purchase') || ', ' ELSE '' END
  || '"k": ' || arg_max(k, event_id) FILTER (WHERE event_type IN ('signup', 'click')) || ', "log": [' || coalesce(string_agg(CAST(k AS VARCHAR), ', ' ORDER BY event_id) FILTER (WHERE event_type = 'error'), '') || '], "seen": "'
  || coalesce(string_agg('v' || k, '' ORDER BY event_id) FILTER (WHERE event_type = 'view'), '') || '"}}' AS content FROM t GROUP BY 1"""


def revisions(spark, d) -> DataFrame:
    """Signups write a base; clicks set, views append to a text, errors splice a list, purchases set a new key."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    t = F.col("event_type")
    op = lambda form, *a: F.format_string(form, *a)
    content = (
        F.when(t == "signup", op('{"k": %s, "seen": "", "log": []}', "k")).when(t == "click", op('[["s", ["k"], %s]]', "k")).when(t == "view", op('[["a", ["seen"], "v%s"]]', "k"))
        .when(t == "error", op('[["e", ["log"], %s]]', "k")).otherwise(op('[["s", ["at"], %d]]', "event_id"))
    )
    return e.select(F.col("user_id").alias("document_id"), F.col("event_id").alias("seq"), F.when(t == "signup", "base").otherwise("delta").alias("kind"), content.alias("content"))


@R.add("d5_base_and_deltas", _REVISIONS.format(k=_K, where=""))
def d5(spark, d) -> DataFrame:
    """The newest base of each document, then the deltas after it in order."""
    return deltas.materialise(revisions(spark, d))


@R.add("d6_as_of_snapshot", _REVISIONS.format(k=_K, where="WHERE event_id <= (SELECT max(event_id) * 7 // 10 FROM events)"))
def d6(spark, d) -> DataFrame:
    """As of seven tenths of the sequence."""
    most = table(spark, d, "events").agg(F.max("event_id").alias("m")).first()["m"] or 0
    return deltas.materialise(revisions(spark, d), most * 7 // 10)


@R.add("x28_json_operations", f"""SELECT event_id, '{{"a": "yz", "c": [' || k || ', 9, 8, 1], "n": ' || k || '}}' AS json FROM (SELECT event_id, {_K} AS k FROM events)""")
def x28(spark, d) -> DataFrame:
    """Set, delete, append, truncate, splice, permute and replace in one batch."""
    base = F.lit('{"a": "x", "b": 2}')
    ops = F.format_string('[["r", {"a": "xy", "b": 2, "c": [1, 2, 3]}], ["s", ["n"], %s], ["d", ["b"]], ["a", ["a"], "z"], ["t", ["a"], 1], ["p", ["c"], 1, 2, [8, 9, %s]], ["m", ["c"], [3, 2, 1, 0]]]', F.col("k").cast("string"), F.col("k").cast("string"))
    return keyed(spark, d).select("event_id", U.applied_ops(base, ops).alias("json"))


@R.add("x29_list_moves", f"""
WITH e AS (SELECT event_id, {_K} AS k FROM events)
SELECT event_id, CASE k % 3 WHEN 0 THEN '[["v", ["l"], [[0, ' || (1 + k % 5) || ', ' || (11 - k % 5) || ']]]]' WHEN 1 THEN '[["p", ["l"], ' || (k % 10) || ', 1, []]]' ELSE '[["p", ["l"], 12, 0, [' || (k % 7) || ', -1]], ["p", ["l"], 0, 2, []]]' END AS ops FROM e""")
def x29_moves(spark, d) -> DataFrame:
    """Differences of lists: a beginning that moves to the end, one element less, both ends changed."""
    k = F.col("k")
    old = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: 100 + i * 10)
    n = (1 + k % 5).cast("int")
    less = F.filter(old, lambda x, i: i != k % 10)
    new = F.when(k % 3 == 0, F.concat(F.slice(old, n + 1, F.lit(12)), F.slice(old, F.lit(1), n))).when(k % 3 == 1, less).otherwise(F.concat(F.slice(old, 3, 10), F.array((k % 7).cast("int"), F.lit(-1))))
    both = keyed(spark, d).select("event_id", F.to_json(F.struct(old.alias("l"))).alias("old"), F.to_json(F.struct(new.alias("l"))).alias("new"))
    return both.select("event_id", U.json_ops("old", "new").alias("ops"))


@R.add("x29_json_differences", "SELECT event_id, true AS same, true AS no_longer FROM events")
def x29(spark, d) -> DataFrame:
    """Operations between two values, applied to the first, give the second; they are never
    longer than replacing the whole."""
    k = F.col("k").cast("string")
    old = F.format_string('{"l": [1, 2, 3, 4, %s, 6], "t": "abc", "x": {"y": %s}}', k, k)
    new = F.format_string('{"l": [2, 3, %s, 4, 6, 7], "t": "abcd%s", "x": {"z": [%s]}}', k, k, k)
    e = keyed(spark, d).select("event_id", old.alias("old"), new.alias("new")).withColumn("ops", U.json_ops("old", "new"))
    return e.select("event_id", (U.applied_ops("old", "ops") == U.sorted_json("new")).alias("same"), (F.length("ops") <= F.length("new") + 10).alias("no_longer"))


# search

_FUZZY = """
WITH c AS (SELECT p_partkey, p_name, lower(p_name) AS t FROM part), a AS (SELECT *, position('s' IN t) AS i1 FROM c WHERE position('s' IN t) > 0),
b AS (SELECT *, i1 + position('r' IN substr(t, i1 + 1)) AS i2 FROM a WHERE position('r' IN substr(t, i1 + 1)) > 0), g AS (SELECT *, i2 + position('g' IN substr(t, i2 + 1)) AS i3 FROM b WHERE position('g' IN substr(t, i2 + 1)) > 0),
s AS (SELECT p_partkey, p_name, CASE WHEN i1 = 1 THEN -5 ELSE 0 END + CASE WHEN i2 = i1 + 1 THEN -5 * CASE WHEN i1 = 1 THEN 2 ELSE 1 END ELSE 2 * (i2 - i1 - 1) END + CASE WHEN i3 = i2 + 1 THEN -5 * CASE WHEN i2 = i1 + 1 THEN CASE WHEN i1 = 1 THEN 3 ELSE 2 END ELSE 1 END ELSE 2 * (i3 - i2 - 1) END
  + list_sum([CASE WHEN i = 1 OR regexp_matches(substr(t, i - 1, 1), '[-_./: ]') THEN -10 ELSE 0 END for i in [i1, i2, i3]]) + 0.1 * (i1 + i2 + i3 - 3) AS score FROM g) """


@R.add("x24_fuzzy_scores", _FUZZY + "SELECT p_partkey, round(score, 6) AS score FROM s")
def x24(spark, d) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", search.fuzzy_score("srg", F.col("p_name")).alias("s"))
    return p.where("s is not null").select("p_partkey", F.round("s", 6).alias("score"))


@R.add("x25_parsed_queries", """
SELECT p_partkey, 'quoted' AS query, round((position('red' IN lower(p_name)) - 1) * 0.1, 6) AS score FROM part WHERE contains(lower(p_name), 'red') UNION ALL SELECT p_partkey, 'pattern', 0.0 FROM part WHERE regexp_matches(p_name, '(?i)^s.*g')""")
def x25(spark, d) -> DataFrame:
    p = table(spark, d, "part")
    one = lambda name, q: p.select("p_partkey", F.lit(name).alias("query"), F.round(search.query_score(q, F.col("p_name")), 6).alias("score")).where("score is not null")
    return one("quoted", '"red"').unionByName(one("pattern", "re:^s.*g"))


@R.add("k7_ranked_matches", _FUZZY + "SELECT p_partkey, round(score, 6) AS score FROM s ORDER BY round(score, 6), p_partkey DESC LIMIT 25")
def k7(spark, d) -> DataFrame:
    """Best first, then newest first."""
    p = table(spark, d, "part").select("p_partkey", F.round(search.query_score("srg", F.col("p_name")), 6).alias("score")).where("score is not null")
    return p.orderBy("score", F.desc("p_partkey")).limit(25)


# sequences of outputs

_OUT = "'total ' || repeat('ab', 20) || ' ' || floor(value / 20)::BIGINT"
_DICE = "list_sum([least(len(list_filter({x}, lambda z: z = g)), len(list_filter({y}, lambda z: z = g))) for g in list_distinct({x})])"


@R.add("w3_stuck_outputs", f"""
WITH o AS (SELECT event_id, {_OUT} AS a, lag({_OUT}) OVER w AS b, lag({_OUT}, 2) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT event_id, a, b, c, [substr(a, i, 2) for i in range(1, length(a))] AS ga, [substr(b, i, 2) for i in range(1, length(b))] AS gb, [substr(c, i, 2) for i in range(1, length(c))] AS gc FROM o WHERE c IS NOT NULL)
SELECT event_id FROM g WHERE (a = b OR 2.0 * {_DICE.format(x='ga', y='gb')} / (len(ga) + len(gb)) >= 0.97) AND (b = c OR 2.0 * {_DICE.format(x='gb', y='gc')} / (len(gb) + len(gc)) >= 0.97) AND (a = c OR 2.0 * {_DICE.format(x='ga', y='gc')} / (len(ga) + len(gc)) >= 0.97)""")
def w3(spark, d) -> DataFrame:
    """Three outputs in a row, cut to their last 2,000 characters, near identical in all three pairs."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    out = F.right(F.concat(F.lit("total "), F.repeat(F.lit("ab"), F.lit(20)), F.lit(" "), F.floor(F.col("value") / 20).cast("string")), F.lit(2000))
    o = table(spark, d, "events").withColumn("a", out).select("event_id", "a", F.lag("a").over(w).alias("b"), F.lag("a", 2).over(w).alias("c")).where("c is not null")
    same = lambda x, y: T.near_identical(F.col(x), F.col(y), limit=0.97)
    return o.where(same("a", "b")).where(same("b", "c")).where(same("a", "c")).select("event_id")


@R.add("x26_runaway_texts", """
WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || repeat(right('0123456789abcdefghijklmnopqrstuvwxyz' || doc_id, 30), 20) WHEN doc_id % 11 < 4 THEN text || repeat(chr(10) || '  a line that comes again ' || doc_id || chr(10) || '}', 6 + doc_id % 3) || CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE '' END ELSE text END AS text FROM documents WHERE length(text) >= 500),
l AS (SELECT doc_id, unnest(list_reverse(string_split(text, chr(10)))[2:61]) AS line FROM d), c AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line, count(*) AS n FROM l GROUP BY 1, 2) WHERE length(line) >= 20 GROUP BY 1)
SELECT doc_id, coalesce(n, 0) >= 8 OR len([p for p in range(20, 81) if substr(right(text, 400), p + 1) = left(right(text, 400), 400 - p)]) > 0 AS runaway FROM d LEFT JOIN c USING (doc_id)""")
def x26(spark, d) -> DataFrame:
    """An end of period 20 to 80, or a line of 20 characters that recurs 8 times among the
    last 60 complete ones; from 500 characters on, as few documents have 20,000."""
    end = F.repeat(F.right(F.concat(F.lit("0123456789abcdefghijklmnopqrstuvwxyz"), F.col("doc_id").cast("string")), F.lit(30)), F.lit(20))
    line = F.concat(F.lit("\n  a line that comes again "), F.col("doc_id").cast("string"), F.lit("\n}"))
    again = F.concat(F.repeat(line, (6 + F.col("doc_id") % 3).cast("int")), F.when(F.col("doc_id") % 2 == 0, "\n").otherwise(""))
    t = table(spark, d, "documents").where("length(text) >= 500").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("text", end)).when(F.col("doc_id") % 11 < 4, F.concat("text", again)).otherwise(F.col("text")).alias("text"))
    return t.select("doc_id", T.runaway(F.col("text"), least=500).alias("runaway"))


@R.add("x43_fuzzy_edits", """
WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS i, coalesce(nullif(regexp_extract(lower(coalesce(text, '')), '[a-z]{3,8}'), ''), 'none') AS w FROM documents)
SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'top' || chr(10) || 'now ' || i || ' “x” ' || chr(10) || 'end  ' WHEN 1 THEN 'a b ' || chr(10) || 'now ' || i || ', "x"' || chr(10) || 'end – ' || i || ' ' END AS content,
  CASE doc_id % 5 WHEN 2 THEN 'several' WHEN 3 THEN 'not found' WHEN 4 THEN 'no change' END AS problem, CASE doc_id % 5 WHEN 0 THEN '2' WHEN 1 THEN '2' WHEN 4 THEN '1' ELSE '' END AS lines FROM d""")
def x43_edits(spark, d) -> DataFrame:
    """One edit of a text: exact, alike only, twice there, not there, and one that changes nothing."""
    i, n = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    w = F.coalesce(F.nullif(F.regexp_extract(F.lower(F.coalesce("text", F.lit(""))), "[a-z]{3,8}", 0), F.lit("")), F.lit("none"))
    text = (
        F.when(n == 0, F.concat(F.lit("top\nsay "), w, F.lit(" “x” \nend  "))).when(n == 1, F.concat(F.lit("a b \nsay ‘"), w, F.lit("’, “x”  \nend – "), i, F.lit(" ")))
        .when(n == 2, F.concat(F.lit("say ‘"), w, F.lit("’ and say '"), w, F.lit("'"))).when(n == 3, F.lit("nothing\nof it")).otherwise(F.concat(F.lit("say "), w))
    )
    old = F.when(n.isin(0, 4), F.concat(F.lit("say "), w)).otherwise(F.concat(F.lit("say '"), w, F.lit("'")))
    new = F.when(n == 4, F.concat(F.lit("say "), w)).otherwise(F.concat(F.lit("now "), i))
    rows = table(spark, d, "documents").select("doc_id", applied_edits(text, F.array(F.struct(old.alias("old"), new.alias("new")))).alias("e"))
    return rows.select("doc_id", "e.content", "e.problem", F.array_join(F.transform("e.lines", lambda x: x.cast("string")), ",").alias("lines"))


@R.add("x39_image_references", """
WITH i AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') || CASE page_id % 3 WHEN 0 THEN ':' || page_id WHEN 1 THEN ':v1/x' ELSE '' END AS x FROM pages),
r AS (SELECT page_id, x, CASE WHEN contains(x, '/') AND (contains(split_part(x, '/', 1), '.') OR contains(split_part(x, '/', 1), ':') OR split_part(x, '/', 1) = 'localhost') THEN split_part(x, '/', 1) END AS registry FROM i),
s AS (SELECT page_id, registry, CASE WHEN registry IS NOT NULL THEN substr(x, length(registry) + 2) ELSE x END AS rest FROM r)
SELECT page_id, registry, regexp_replace(rest, ':[^:/]+$', '') AS repository, coalesce(nullif(regexp_extract(rest, ':([^:/]+)$', 1), ''), 'latest') AS tag FROM s""")
def x39(spark, d) -> DataFrame:
    n = F.col("page_id") % 3
    tail = F.when(n == 0, F.concat(F.lit(":"), F.col("page_id").cast("string"))).when(n == 1, ":v1/x").otherwise("")
    t = table(spark, d, "pages").where("url is not null").select("page_id", F.concat(F.regexp_replace("url", "^[a-z]+://", ""), tail).alias("x"))
    return t.select("page_id", T.image_parts(F.col("x")).alias("p")).select("page_id", "p.registry", "p.repository", "p.tag")
