"""Why a failed call failed: messages by class, and paths that were wrong rather than missing.

A class is a list of the messages that programs print, each compiled to one pattern; the
classes are tried in the survey's order. Whether a missing path had been shown before, in
another place, is a join: every path-like word of earlier outputs of the session is kept
once under its last name with the first turn that showed it, and a failure meets those of
the same name. No output is read again for a later failure.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shell
from .shells import SEARCHING, base
from .steps import SPENT

#: What programs print, by class, in plain words. <name> stands for one word,
#: <n> for a number, ... for the rest of the line, ^ for a line's start, $ for its end.
MESSAGES = {
    "timeout or killed": ["Command timed out after", "^Killed$", "^Killed "],
    "interpreter": ["^python: command not found", "^pip: command not found", ": python: command not found", ": pip: command not found", "/usr/bin/env: 'python': No such file", "/usr/bin/env: python: No such file", "/usr/bin/env: ‘python’: No such file", "/usr/bin/env: 'node': No such file", "/usr/bin/env: node: No such file", "/usr/bin/env: ‘node’: No such file", "cannot execute: required file not found", "bad interpreter"],
    "program": ["^<program>: command not found", ": <program>: command not found", "^sh: <n>: <program>: not found", "^/bin/sh: <n>: <program>: not found"],
    "module": ["No module named", "Cannot find module '", "fatal error: <name>.h: No such file", "cannot find -l<name>", "error while loading shared libraries: <name>", "there is no package called", "ImportError: lib<name>.so"],
    "permission": ["Permission denied"],
    "network": [
        "Could not resolve host", "Temporary failure in name resolution", "Name or service not known", "Network is unreachable", "Failed to connect", "Connection refused", "Connection timed out", "HTTP Error <n>", "403 Not Found", "404 Not Found", "curl: (<n>)",
        "Max retries exceeded", "urlopen error", "Could not find a version that satisfies", "No matching distribution found", "ERROR <n>:", "unable to access 'http", "Failed to fetch", "Read timed out",
    ],
    "install": ["externally-managed-environment", "Unable to locate package", "has no installation candidate", "E: Package <name> has no", "E: Package '<name>' has no", "No package <name> available"],
    "syntax": [
        "^SyntaxError", "^IndentationError", "^TabError", "^ SyntaxError", "syntax error near unexpected token", "unexpected EOF while looking for", "syntax error at ... line <n>", "^<name>:<n>: error:", "^<name>:<n>:<n>: error:", "^<name>:<n>: fatal error:", "^<name>:<n>:<n>: fatal error:",
        "^error:", "^error[E<n>]:", "undefined reference to", "ld returned <n> exit status", "unknown option to `s'", "unterminated `s' command", "error TS<n>", "jq: error ...compile", "^Error: Parse error", "parse error",
    ],
    "path": ["No such file or directory", "Directory nonexistent"],
    "tests": ["<count> failed", "^FAILED", "^FAIL ", "^FAIL$", "^FAIL:", "AssertionError", "test failed", "tests failed", "MISMATCH", "assertion ...failed"],
    "exception": ["Traceback (most recent call last)", "Segmentation fault", "core dumped", "panicked at", "Exception in thread", "Uncaught", "terminate called", "^<word>Error", "^Error", "^ERROR", "^error", "Aborted"],
}
#: Exit codes and exceptions that name a class by themselves.
CODES = {"timeout or killed": (124, 137, 143), "exception": (134, 136, 139, 6)}
RAISED = {"module": ("ModuleNotFoundError",), "syntax": ("SyntaxError", "IndentationError", "TabError"), "path": ("FileNotFoundError", "NotADirectoryError"), "tests": ("AssertionError",)}
#: Where a message names the path that it misses, the first that fits.
PATHS = (
    "cannot access '<path>': No such file", "can't open file '<path>'", "No such file or directory: '<path>'", "cannot create regular file '<path>': No such file", "cannot create directory '<path>': No such file", "cannot stat '<path>': No such file", "cannot open '<path>': No such file",
    "cannot remove '<path>': No such file", "cannot create <bare>: Directory nonexistent", "cd: <bare>: No such file or directory", "^<bare>: No such file or directory", ": <bare>: No such file or directory", "Could not open input file: <bare>", "Could not open file '<path>'",
)
#: File names that say nothing about where a file is.
COMMON_NAMES = set(
    "__init__.py main.py setup.py index.html README.md README Makefile config.json test.py main time git app tmp src lib bin data test tests build out output input log logs run run.sh build.sh a.out core dist include python python3 venv node_modules package.json config utils.py".split()
)
#: Programs that fail without a word when they find nothing.
SILENT = [*SEARCHING, *"which diff cmp test [ [[ command find ls pgrep type pip pip3 dpkg head tail cat kill pidof whereis file stat wc sed awk sort".split()]

_HOLES = {"<name>": r"\S+", "<word>": r"\w+", "<n>": r"\d+", "<count>": r"\b[1-9]\d*", "<program>": r"[^\s:/]+", "<path>": r"([^'\n]+)", "<bare>": r"'?([^\s:']+)'?", "...": "[^\\n]*", "^": r"(?:^\s*)", "$": r"(?:$)"}
_HOLE = re.compile("|".join(map(re.escape, _HOLES)))


def pattern(messages: Sequence[str]) -> str:
    """One pattern for the messages: their words as they are, their holes filled."""
    out = []
    for m in messages:
        at, piece = 0, ""
        for hole in _HOLE.finditer(m):
            if hole[0] == "^" and hole.start() or hole[0] == "$" and hole.end() < len(m):
                continue
            piece += re.escape(m[at : hole.start()]) + _HOLES[hole[0]]
            at = hole.end()
        out.append(piece + re.escape(m[at:]))
    return "(?m)" + "|".join(out).replace("\\ ", " ").replace("`", "\\x60")


def last_exception(output: Column) -> Column:
    """The name of the last exception line behind the last traceback; null without one."""
    mark = "Traceback (most recent call last)"
    names = F.regexp_extract_all(F.substring_index(output, mark, -1), F.lit(r"(?m)^(?:\w+\.)*([A-Za-z_]\w*(?:Error|Exception|Exit|Interrupt|Warning|error)|error)(?=:|\s*$)"), F.lit(1))
    return F.when(F.contains(output, F.lit(mark)), F.try_element_at(names, F.lit(-1)))


def missing_path(output: Column) -> Column:
    """The path that an output misses; null where it names none."""
    named = F.array(*[F.regexp_extract(output, pattern([m]), 1) for m in PATHS])
    bare = F.transform(named, lambda x: F.regexp_replace(F.regexp_replace(x, "^[\\s'\"]+|[\\s'\"]+$", ""), "/+$", ""))
    return F.get(F.filter(bare, lambda x: ~x.isin("", ".", "..")), F.lit(0))


def shown_paths(calls: DataFrame, session: Sequence[str], turn: str, output: str) -> DataFrame:
    """(session, name, path, shown_at): path-like words of outputs under their last name, with
    the first turn that shows each."""
    # the word ends where no further letter, digit or dash follows, and does not begin inside another
    words = F.array_distinct(F.regexp_extract_all(F.coalesce(output, F.lit("")), F.lit(r"(?<![\w./~-])[\w./~-]*[\w-]"), F.lit(0)))
    rows = calls.select(*session, F.col(turn).alias("_turn"), F.explode(words).alias("path"))
    rows = rows.withColumn("name", base(F.col("path"))).where((F.col("name") != "") & (F.contains("path", F.lit("/")) | ((F.length("name") >= 3) & (F.contains("name", F.lit(".")) | (F.length("name") >= 5)))))
    return rows.groupBy(*session, "name", "path").agg(F.min("_turn").alias("shown_at"))


def wrong_paths(missing: DataFrame, shown: DataFrame, session: Sequence[str], turn: str) -> DataFrame:
    """(session, turn) of missing (session, turn, path) whose file was shown before in
    another place: a path that ends in the same folder and name, or in the name alone when
    that tells enough. The same place written shorter does not count."""
    name = base(F.col("path"))
    tells = ~name.isin(*sorted(COMMON_NAMES)) & (F.length(name) >= 3) & (F.contains(F.regexp_replace(name, r"^\.+|\.+$", ""), F.lit(".")) | (F.length(name) >= 5))
    folder = F.try_element_at(F.split("path", "/"), F.lit(-2))
    given = missing.select(*session, turn, "path", name.alias("name"), tells.alias("tells"), F.when(~folder.isin("", ".", "..", "~"), folder).alias("folder"))
    met = given.join(shown.withColumnRenamed("path", "seen"), [*session, "name"]).where((F.col("shown_at") < F.col(turn)) & (F.col("seen") != F.col("path")))
    same = F.endswith(F.col("path"), F.concat(F.lit("/"), F.col("seen")))
    near = F.coalesce(F.endswith(F.col("seen"), F.concat("folder", F.lit("/"), "name")), F.lit(False))
    bare = F.col("seen") == F.col("name")
    fits = F.when(bare, F.col("tells") & F.contains("path", F.lit("/"))).otherwise(~same & (near | F.col("tells")))
    return met.where(fits).select(*session, turn).distinct()


def classified(calls: DataFrame, session: Sequence[str], turn: str, command: str = "command", output: str = "output", code: str = "code") -> DataFrame:
    """Failed calls with `class` and `detail` (the path, program or exception that it names).

    Classes, the first that fits: malformed, timeout or killed, interpreter, program, module,
    no execute permission, permission, local server, network, install, syntax, git, missing
    folder, wrong path, missing path, tests, exception, nothing found, no error text. The
    last exception of a traceback decides before the output's text does. calls holds every
    call of a session, its turns numbered; rows with a null output are not classified.
    """
    # columns that the ladder looks at, under names of their own
    o, c, n = F.col(output), F.coalesce(F.col(command), F.lit("")), F.col(code)
    says = lambda cls: F.rlike(o, F.lit(pattern(MESSAGES[cls])))
    rows = calls.withColumns({"_parts": shell.parsed(command), "_exception": last_exception(o), "_missing": missing_path(o)})
    raised = lambda cls: F.coalesce(F.col("_exception").isin(*RAISED[cls]), F.lit(False))
    exits = lambda cls: F.coalesce(n.isin(*CODES[cls]), F.lit(False))
    unnamed, parts = F.col("_exception").isNull(), F.coalesce("_parts", F.array().cast(rows.schema["_parts"].dataType))
    word = lambda p: base(F.get(p["argv"], F.lit(0)))
    run_path = F.filter(F.transform(parts, lambda p: F.get(p["argv"], F.lit(0))), lambda w: F.contains(w, F.lit("/")))
    refused = F.get(F.filter(run_path, lambda w: F.contains(o, F.concat(w, F.lit(": Permission denied")))), F.lit(0))
    program = F.coalesce(*[F.nullif(F.regexp_extract(o, pattern([m.replace("<program>", "<bare>")]), 1), F.lit("")) for m in MESSAGES["program"]])
    local = F.rlike(F.concat(c, o), F.lit(r"localhost|127\.0\.0\.1|0\.0\.0\.0|\[::1\]"))
    gone = raised("path") | (unnamed & says("path"))
    into = F.exists(parts, lambda p: F.exists(p["outputs"], lambda x: F.regexp_replace(x, "/+$", "") == F.col("_missing")))
    folder = F.contains(o, F.lit("Directory nonexistent")) | F.contains(o, F.lit("cannot create")) | (into & F.rlike(o, F.lit(r"(?m)^(/bin/)?(ba)?sh: ")))
    tested = F.exists(parts, lambda p: word(p).isin(*SPENT["tests"].split()) | F.arrays_overlap(p["argv"], F.array(F.lit("pytest"), F.lit("unittest")))) & (n > 0)
    acting = F.filter(parts, lambda p: (F.size(p["argv"]) > 0) & ~word(p).isin(*SPENT["neutral"].split(), "echo", "printf"))
    ladder = (
        F.when(F.startswith(o, F.lit("Validation failed for tool")), "malformed").when(says("timeout or killed") | exits("timeout or killed"), "timeout or killed").when(says("interpreter"), "interpreter").when(says("program"), "program")
        .when(raised("module") | says("module"), "module").when(says("permission"), F.when(F.col("_refused").isNotNull(), "no execute permission").otherwise("permission"))
        .when(F.contains(o, F.lit("Connection refused")) & local, "local server").when(F.rlike(o, F.lit("(?i)" + pattern(MESSAGES["network"]))), "network").when(says("install"), "install")
        .when(raised("syntax") | (unnamed & says("syntax")), "syntax").when(F.rlike(o, F.lit("(?m)^fatal: ")) & F.contains(c, F.lit("git")), "git")
        .when(gone & F.col("_missing").isNotNull() & folder, "missing folder").when(gone & F.col("_wrong"), "wrong path").when(gone & F.contains(o, F.concat(F.lit("cd: "), "_missing")), "missing folder").when(gone, "missing path")
        .when(raised("tests") | F.rlike(o, F.lit("(?i)" + pattern(MESSAGES["tests"]))) | tested, "tests").when(~unnamed | says("exception") | exits("exception"), "exception")
        .when(word(F.try_element_at(acting, F.lit(-1))).isin(*SILENT), "nothing found").otherwise("no error text")
    )
    got = F.col("_class")
    detail = F.when(got == "program", F.col("_program")).when(got == "no execute permission", F.col("_refused")).when(got.isin("missing folder", "wrong path", "missing path"), F.col("_missing")).when(got.isin("syntax", "tests", "exception"), F.col("_exception"))
    rows = rows.withColumns({"_refused": refused, "_program": program})
    shown = shown_paths(calls, session, turn, output)
    missing = rows.where("_missing is not null").select(*session, turn, F.col("_missing").alias("path")).distinct()
    wrong = wrong_paths(missing, shown, session, turn).withColumn("_wrong", F.lit(True))
    rows = rows.join(wrong, [*session, turn], "left").withColumn("_wrong", F.coalesce("_wrong", F.lit(False)))
    return rows.where(o.isNotNull()).withColumn("_class", ladder).select(*calls.columns, got.alias("class"), detail.alias("detail"))
