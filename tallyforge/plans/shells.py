"""Queries over shell commands: composed from prefixes, programs with their arguments, ways of
quoting and endings, with words and numbers of the documents put in. The SQL composes what
each must give from what its pieces mean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shell
from ..operators import shells, steps
from ..sources.tables import table
from .commands import values
from .registry import Registry

R = Registry()
QUERIES, ORACLE_SQL = R.queries, R.sql

#: Program with arguments ({f} a file, quoted in one of several ways; {w} a word; {k} a number) -> its simple commands joined by " ~ ",
#: intent, target, targets, aspect, first and last line; what the step is about (kind, category), the same when it writes a file; what its time goes to, the same when it writes a file.
BASES = (
    ("cat {f}", "cat {f}", "read", "{f}", "", "", None, None, "info", "file.read", "act", "write.file", "information", "write"),
    ("cat -A {f}", "cat -A {f}", "peek", "{f}", "", "", None, None, "info", "file.read", "act", "write.file", "information", "write"),
    ("head -n {k} {f}", "head -n {k} {f}", "read", "{f}", "", "", "1", "{k}", "info", "file.read", "act", "write.file", "information", "information"),
    ("head -c 64 {f}", "head -c 64 {f}", "peek", "{f}", "", "bytes", None, None, "info", "data.bytes", "act", "write.file", "information", "information"),
    ("tail -20 {f}", "tail -20 {f}", "read", "{f}", "", "", None, None, "info", "file.read", "act", "write.file", "information", "information"),
    ("tail -f {w}.log", "tail -f {w}.log", "service", "{w}.log", "", "log", None, None, "info", "logs", "act", "write.file", "wait", "wait"),
    ("sed -n '{k},9999p' {f}", "sed -n {k},9999p {f}", "read", "{f}", "", "", "{k}", "9999", "info", "file.read", "info", "file.read", "information", "write"),
    ("sed -i 's/{w}/x/' {f}", "sed -i s/{w}/x/ {f}", "other", None, "", "", None, None, "act", "edit.file", "act", "edit.file", "write", "write"),
    ("awk '{print $1}' {f}", "awk {print $1} {f}", "peek", "{f}", "", "", None, None, "info", "data.inspect", "act", "write.file", "information", "write"),
    ("wc -l {f}", "wc -l {f}", "peek", "{f}", "", "lines", None, None, "info", "data.inspect", "info", "data.inspect", "information", "information"),
    ("xxd -l {k} {f}", "xxd -l {k} {f}", "peek", "{f}", "", "bytes", None, None, "info", "data.bytes", "info", "data.bytes", "information", "information"),
    ("file {f} b{k}", "file {f} b{k}", "peek", "{f}", "{f},b{k}", "type", None, None, "info", "data.bytes", "info", "data.bytes", "information", "information"),
    ("ls -la src/{w}", "ls -la src/{w}", "list", "src/{w}", "", "", None, None, "info", "file.list", "info", "file.list", "information", "information"),
    ("grep -rn '{w}\\|a{k}' src", "grep -rn {w}\\|a{k} src", "search", "{w}\\|a{k}", "{w}|a{k},{w},a{k}", "", None, None, "info", "file.search", "info", "file.search", "information", "information"),
    ("rg -e {w} -e b{k} {f}", "rg -e {w} -e b{k} {f}", "search", "{w}", "{w},b{k}", "", None, None, "info", "file.search", "info", "file.search", "information", "information"),
    ("find . -name {f} -type f", "find . -name {f} -type f", "find", "{f}", "", "-name", None, None, "info", "file.find", "info", "file.find", "information", "information"),
    ("find src -type f | xargs grep -l {w}", "find src -type f ~ xargs grep -l {w}", "search", "{w}", "{w}", "", None, None, "info", "file.search", "act", "write.file", "information", "information"),
    ("find . -name {f} -delete", "find . -name {f} -delete", "other", None, "", "", None, None, "act", "write.file", "act", "write.file", "information", "information"),
    ("which {w} gcc", "which {w} gcc", "toolchain", "{w}", "{w},gcc", "program", None, None, "info", "env.tool", "info", "env.tool", "information", "information"),
    ("pip install '{w}=={k}' b", "pip install {w}=={k} b", "install", "{w}", "{w},b", "", None, None, "act", "install", "act", "install", "install", "install"),
    ("pip list | grep -i {w}", "pip list ~ grep -i {w}", "toolchain", "{w}", "{w}", "package", None, None, "info", "env.packages", "act", "write.file", "information", "information"),
    ("apt-get install -y {w}", "apt-get install -y {w}", "install", "{w}", "{w}", "", None, None, "act", "install", "act", "install", "install", "install"),
    ("npm test", "npm test", "check", "npm test", "", "", None, None, "act", "test", "act", "test", "tests", "tests"),
    ("python -c 'import {w}, b{k}'", "python -c import {w}, b{k}", "toolchain", "{w}", "{w},b{k}", "module", None, None, "info", "env.packages", "info", "env.packages", "information", "information"),
    ("python3 -m pytest -q {f}", "python3 -m pytest -q {f}", "check", "python3 -m pytest -q {f}", "", "", None, None, "act", "test", "act", "test", "tests", "tests"),
    ("python {f} --n {k}", "python {f} --n {k}", "run", "{f}", "", "", None, None, "act", "run", "act", "run", "run other", "run other"),
    ("bash {f} {w}", "bash {f} {w}", "run", "{f}", "", "", None, None, "act", "run", "act", "run", "run other", "run other"),
    ("./{w}{k} --fast", "./{w}{k} --fast", "run", "./{w}{k}", "", "", None, None, "act", "run", "act", "run", "run other", "run other"),
    ("make -j{k} {w}", "make -j{k} {w}", "check", "make -j{k} {w}", "", "", None, None, "act", "build", "act", "build", "run other", "run other"),
    ("cargo test {w}", "cargo test {w}", "check", "cargo test {w}", "", "", None, None, "act", "test", "act", "test", "tests", "tests"),
    ("curl -s http://localhost:80{k}/{w}", "curl -s http://localhost:80{k}/{w}", "service", "80{k}", "", "port", None, None, "info", "service.check", "info", "service.check", "tests", "tests"),
    ("ps aux", "ps aux", "service", "processes", "", "processes", None, None, "info", "service.check", "info", "service.check", "wait", "wait"),
    ("man {w}", "man {w}", "docs", "{w}", "", "", None, None, "info", "api.help", "info", "api.help", "information", "information"),
    ("gcc --version", "gcc --version", "toolchain", "gcc", "gcc", "program", None, None, "info", "env.tool", "info", "env.tool", "information", "information"),
    ("git log -n {k}", "git log -n {k}", "other", None, "", "", None, None, "info", "git.state", "info", "git.state", "information", "information"),
    ("echo {w} {k}", "echo {w} {k}", "neutral", None, "", "", None, None, "neutral", "shell", "act", "write.file", "neutral", "write"),
    ("sqlite3 {f} 'SELECT a FROM {w} LIMIT {k}'", "sqlite3 {f} SELECT a FROM {w} LIMIT {k}", "peek", "{f}", "", "schema", None, None, "info", "data.query", "info", "data.query", "information", "information"),
    ("jq keys {f}", "jq keys {f}", "peek", "{f}", "", "keys", None, None, "info", "data.inspect", "act", "write.file", "information", "information"),
    ("command -v {w}", "command -v {w}", "toolchain", "{w}", "{w}", "program", None, None, "info", "env.tool", "info", "env.tool", "information", "information"),
    ("rm -rf {w}{k}", "rm -rf {w}{k}", "other", None, "", "", None, None, "act", "write.file", "act", "write.file", "other", "other"),
)
#: What stands before a program -> its words.
PREFIXES = (("", ""), ("timeout 60 ", "timeout 60 "), ("A{k}=1 ", "A{k}=1 "), ("env B=\"x {w}\" ", "env B=x {w} "), ("nice -n 5 ", "nice -n 5 "), ("cd /{w} && ", "cd /{w} ~ "))
#: A file's name as it is written.
QUOTES = (("", ""), ("'", "'"), ('"', '"'))
#: What stands behind -> a command that follows, and whether the command writes a file.
ENDINGS = (("", "", False), (" 2>/dev/null", "", False), (" 2>&1", "", False), (" | head -5", " ~ head -5", False), (" > out{k}.txt", "", True), (" # a note; not a command", "", False))

_PICK = """
WITH d AS (SELECT doc_id, doc_id % 97 + 1 AS k, coalesce(nullif(regexp_extract(lower(coalesce(text, '')), '[a-z]{3,8}'), ''), 'none') AS w FROM documents),
n AS (SELECT doc_id, k, w, CASE doc_id % 3 WHEN 0 THEN w || k || '.txt' WHEN 1 THEN 'my ' || w || '.txt' ELSE 'src/' || w || '.txt' END AS f, CASE WHEN doc_id % 3 = 1 THEN 1 + doc_id % 2 ELSE doc_id // 5 % 3 END AS q FROM d),
""" + f"""
p AS (SELECT n.*, b.*, x.lead, e.follows, e.writes FROM n JOIN {values(BASES, 'command, words, kind, target, targets, aspect, first, last, about, category, about_w, category_w, spent, spent_w').replace(' t(', ' b(')} ON b.i = doc_id % {len(BASES)}
  JOIN {values(PREFIXES, 'prefix, lead').replace(' t(', ' x(')} ON x.i = doc_id // 7 % {len(PREFIXES)} JOIN {values(ENDINGS, 'ending, follows, writes').replace(' t(', ' e(')} ON e.i = doc_id // 11 % {len(ENDINGS)}) """
_FILL = "replace(replace(replace({}, '{{f}}', f), '{{w}}', w), '{{k}}', CAST(k AS VARCHAR))"


def composed(spark, d) -> DataFrame:
    """(doc_id, command): prefix, program with arguments and ending, each picked by the id, with the document's first word."""
    i, k = F.col("doc_id"), F.col("k")
    pick = lambda rows, n, j=0: F.get(F.array(*[F.lit(r[j]) for r in rows]), n.cast("int"))
    docs = table(spark, d, "documents").select("doc_id", (i % 97 + 1).alias("k"), F.coalesce(F.nullif(F.regexp_extract(F.lower(F.coalesce("text", F.lit(""))), "[a-z]{3,8}", 0), F.lit("")), F.lit("none")).alias("w"))
    name = F.when(i % 3 == 0, F.concat("w", k.cast("string"), F.lit(".txt"))).when(i % 3 == 1, F.concat(F.lit("my "), "w", F.lit(".txt"))).otherwise(F.concat(F.lit("src/"), "w", F.lit(".txt")))
    q = F.when(i % 3 == 1, 1 + i % 2).otherwise(F.floor(i / 5) % 3)  # a name with a blank is always quoted
    mark = pick(QUOTES, q)
    line = F.concat(pick(PREFIXES, F.floor(i / 7) % len(PREFIXES)), pick(BASES, i % len(BASES)), pick(ENDINGS, F.floor(i / 11) % len(ENDINGS)))
    put = lambda c, what, by: F.replace(c, F.lit(what), by)
    return docs.select("doc_id", put(put(put(line, "{f}", F.concat(mark, name, mark)), "{w}", F.col("w")), "{k}", k.cast("string")).alias("command"))


def _last(df: DataFrame) -> DataFrame:
    """Of a composed command's rows, that of its program: the second where a cd stands before it."""
    cd = F.floor(F.col("doc_id") / 7) % len(PREFIXES) == len(PREFIXES) - 1
    return df.where(F.col("place") == F.when(cd, 1).otherwise(0)).drop("place")


@R.add("x14_shell_parts", _PICK + f"SELECT doc_id, {_FILL.format('lead || words || follows')} AS parts FROM p")
def x14(spark, d) -> DataFrame:
    words = F.transform(shell.parsed("command"), lambda p: F.array_join(F.concat(p["lead"], p["argv"]), " "))
    return composed(spark, d).select("doc_id", F.array_join(words, " ~ ").alias("parts"))


@R.add("x15_program_and_file_write", _PICK + f"SELECT doc_id, split_part(split_part({_FILL.format('words')}, ' ', 1), '/', -1) AS program, writes FROM p")
def x15(spark, d) -> DataFrame:
    rows = shells.simple_commands(composed(spark, d), ["doc_id"], "command").where("part.stage = 0")
    return _last(rows.select("doc_id", "place", shells.base(F.get("part.argv", F.lit(0))).alias("program"), ((F.size("part.outputs") > 0) | F.exists("stages", lambda p: F.size(p["outputs"]) > 0)).alias("writes")))


@R.add("x16_intents", _PICK + f"""
SELECT doc_id, CASE WHEN writes THEN 'other' ELSE kind END AS kind, CASE WHEN NOT writes THEN {_FILL.format('target')} END AS target, CASE WHEN writes THEN '' ELSE {_FILL.format('targets')} END AS targets, CASE WHEN writes THEN '' ELSE aspect END AS aspect,
  CASE WHEN NOT writes THEN CAST({_FILL.format('first')} AS INTEGER) END AS first, CASE WHEN NOT writes THEN CAST({_FILL.format('last')} AS INTEGER) END AS last, CASE WHEN NOT writes AND kind IN ('run', 'check') THEN {_FILL.format("CASE WHEN lead LIKE 'cd %' THEN '' ELSE lead END || words")} END AS argv FROM p""")
def x16(spark, d) -> DataFrame:
    """Kind, target, aspect and lines of each command, over thousands of shapes."""
    got = _last(shells.intents(composed(spark, d), ["doc_id"], "command"))
    return got.select("doc_id", "kind", "target", F.array_join("targets", ",").alias("targets"), "aspect", "first", "last", F.array_join("argv", " ").alias("argv"))


@R.add("p5_handler_table", _PICK + """
SELECT doc_id, CASE WHEN writes OR kind NOT IN ('read', 'peek', 'list', 'search', 'find', 'toolchain', 'service', 'docs') THEN FALSE ELSE TRUE END AS informs, NOT writes AND kind = 'neutral' AS neutral FROM p""")
def p5(spark, d) -> DataFrame:
    """Whether a command only gathers information, by the handlers of its programs."""
    return shells.gathering(shells.intents(composed(spark, d), ["doc_id"], "command"), ["doc_id"])


@R.add("x17_step_abouts", _PICK + "SELECT doc_id, CASE WHEN writes THEN about_w ELSE about END AS kind, CASE WHEN writes THEN category_w ELSE category END AS category FROM p")
def x17_abouts(spark, d) -> DataFrame:
    return _last(steps.abouts(composed(spark, d), ["doc_id"], "command"))


@R.add("x17_step_times", _PICK + "SELECT doc_id, CASE WHEN writes THEN spent_w ELSE spent END AS kind FROM p")
def x17_times(spark, d) -> DataFrame:
    """What the time of each command goes to, every command a session of its own."""
    return _last(steps.timed(composed(spark, d).withColumn("turn", F.lit(0)), ["doc_id"], "turn", "command")).select("doc_id", "kind")


#: Ways to write a file, and ways to run one.
WRITING = ("cat > f{k}.py <<'END'\nprint({k})\nEND", "echo 'print(1)' >> src/f{k}.py", "sed -i 's/a/b/' f{k}.py", "echo 1 | tee f{k}.py", "cp a.py out/f{k}.py")
RUNNING = ("python f{k}.py", "timeout 9 python3 -u src/f{k}.py --fast 2>&1 | tail -3", "python -m f{k}", "gcc -o prog f{k}.py", "make all")


@R.add("x17_session_steps", """
WITH c AS (SELECT conv_id, turn, (conv_id * 5 + turn * 3) % 7 < 3 AS writes, (conv_id + turn * turn) % 4 AS k, (conv_id + turn) % 5 AS i FROM conversations),
w AS (SELECT conv_id, k, min(turn) AS at FROM c WHERE writes GROUP BY 1, 2), b AS (SELECT conv_id, min(turn) AS at FROM c WHERE writes OR i = 3 GROUP BY 1)
SELECT c.conv_id, c.turn, CASE WHEN writes THEN CASE i WHEN 4 THEN 'other' WHEN 3 THEN 'neutral' ELSE 'write' END WHEN i = 4 THEN CASE WHEN b.at < c.turn THEN 'run own' ELSE 'run other' END WHEN w.at < c.turn THEN 'run own' ELSE 'run other' END AS kind,
  CASE WHEN NOT writes AND i <> 4 THEN 'f' || c.k || '.py' END AS ran
FROM c LEFT JOIN w ON w.conv_id = c.conv_id AND w.k = c.k LEFT JOIN b ON b.conv_id = c.conv_id""")
def x17_sessions(spark, d) -> DataFrame:
    """Sessions of writing and running steps: a run is the session's own if an earlier turn wrote its file."""
    c, t = F.col("conv_id"), F.col("turn")
    writes, k, i = (c * 5 + t * 3) % 7 < 3, (c + t * t) % 4, ((c + t) % 5).cast("int")
    line = lambda rows: F.get(F.array(*map(F.lit, rows)), i)
    steps_ = table(spark, d, "conversations").select("conv_id", "turn", F.replace(F.when(writes, line(WRITING)).otherwise(line(RUNNING)), F.lit("{k}"), k.cast("string")).alias("command"))
    return steps.timed(steps_, ["conv_id"], "turn", "command").where("place = 0").select("conv_id", "turn", "kind", "ran")
