"""What shell commands are for: intents with their targets, and two older classifications.

Commands become rows of simple commands (functions.shell); everything after that is a table
of rules compiled to Column expressions, and, where a session matters, a join by file name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shell

Rule = Callable[[], Column]
INTENT = "struct<kind:string,target:string,targets:array<string>,aspect:string,first:int,last:int>"


def simple_commands(df: DataFrame, keys: Sequence[str], command: str) -> DataFrame:
    """A row per simple command: the keys, place (from 0), part, and the later stages of its pipe."""
    whole = df.select(*keys, shell.parsed(command).alias("_parts")).where("_parts is not null")
    rows = whole.select(*keys, "_parts", F.posexplode("_parts").alias("place", "part"))
    stages = F.filter("_parts", lambda p: (p["pipe"] == F.col("part.pipe")) & (p["stage"] > F.col("part.stage")))
    return rows.select(*keys, "place", "part", stages.alias("stages"))


def base(path: Column) -> Column:
    """A path's last name."""
    return F.substring_index(path, "/", -1)


def _program(part: Column) -> Column:
    return base(F.get(part["argv"], F.lit(0)))


def _has(args: Column, *options: str) -> Column:
    return F.arrays_overlap(args, F.array(*map(F.lit, options)))


def _starts(args: Column, *words: str) -> Column:
    return F.get(args, F.lit(0)).isin(*words)


def _after(args: Column, *options: str) -> Column:
    """The word behind the first of the options that is there."""
    return F.coalesce(*[F.when(F.array_position(args, o) > 0, F.get(args, F.array_position(args, o).cast("int"))) for o in options])


def _plain(args: Column, taking: Column) -> Column:
    """The words that are neither options nor the value of an option of `taking`."""
    value = lambda i: (i > 0) & F.coalesce(F.array_contains(taking, F.get(args, i - 1)), F.lit(False))
    return F.filter(args, lambda x, i: (~x.startswith("-") | (x == "-")) & ~value(i))


def _any(args: Column, pattern: str) -> Column:
    return F.exists(args, lambda x: F.rlike(x, F.lit(pattern)))


#: Options that take the next word as their value, by program.
TAKING = {
    "head tail": "-n -c --lines --bytes", "sed": "-e", "awk gawk jq cut sort uniq column wc": "-F -d -f -k -t -v", "od": "-A -j -N -t -w -S", "xxd": "-l -s -c -g -o -n", "hexdump": "-n -s -e -f", "file": "-m -e -F", "strings": "-n -t -e",
    "pdftotext": "-f -l", "sqlite3 duckdb": "-cmd -separator", "ls tree du stat": "-L -I --max-depth -d", "grep egrep fgrep rg ag ack zgrep": "-A -B -C -m -f -d -D --include --exclude --exclude-dir --max-count -g -t --type",
    "pip pip3 uv conda poetry apt-get apt apk yum dnf": "-r -c -i --index-url --extra-index-url -t --target -f --find-links", "curl wget http": "-H --header -m --max-time -w --connect-timeout -u -A",
    "xargs": "-I -n -P -L -d -s -E -a --max-args --max-procs --delimiter --arg-file", "python python3": "-W -X",
}
#: Programs of a kind.
NEUTRAL = "cd pushd popd export set unset source . sleep clear true alias shopt wait exit reset pwd echo printf test [ [[ :".split()
SHOWING = "cat less more nl bat tac zcat".split()
SEARCHING = "grep egrep fgrep rg ag ack zgrep".split()
BYTES = "od xxd hexdump strings file readelf objdump nm identify exiftool pdfinfo ffprobe mediainfo".split()
HEX = "xxd od hexdump".split()
DATA, SCRIPTED = "cut sort uniq column wc".split(), "awk gawk jq".split()
INTERPRETERS = "ruby perl php Rscript julia lua bash sh deno bun".split()
PROCESSES = "ps pgrep pidof ss netstat lsof top fuser".split()
HARMLESS = [*SEARCHING, *SHOWING, *"ls wc head tail file stat du basename dirname echo".split()]
SERVICES = {"nginx": ("nginx", "-t -T"), "apache2ctl": ("apache2", "configtest -t"), "apachectl": ("apache2", "configtest -t"), "redis-cli": ("redis", "ping"), "pg_isready": ("postgres", "")}
LOADERS = ["json.load(open", "json.loads(open", "read_csv", "read_json", "read_parquet", "read_excel", "read_table", "np.load", "numpy.load", "pickle.load(open", "torch.load", "Image.open", "h5py.File", "sqlite3.connect", "PdfReader", "load_workbook"]
SAVERS = [".write(", "to_csv", "to_json", "to_parquet", "json.dump(", "np.save", "torch.save", "os.remove", "os.rename", "os.unlink", "shutil.", "subprocess"]

_QUOTE = "['\\\"]"
LOADING = "(?:" + "|".join(w.replace(".", r"\.").replace("(", r"\(\s*") for w in LOADERS) + rf")\(?\s*{_QUOTE}([^'\"]+){_QUOTE}"
SAVING = "|".join(w.replace(".", r"\.").replace("(", r"\(") for w in SAVERS) + rf"|open\([^)]*{_QUOTE}[wax]b?\+?{_QUOTE}"
IMPORTING = r"^\s*(?:import|from)\s+[\w.]+[\w., ]*(?:\s+import\s+[\w., *]+)?\s*(?:;\s*print\([^)]*\))?\s*;?\s*$"


def _out(kind, target=None, aspect="", targets=None, first=None, last=None) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    many = F.array().cast("array<string>") if targets is None else targets
    return F.struct(lit(kind).cast("string").alias("kind"), lit(target).cast("string").alias("target"), many.alias("targets"), lit(aspect).cast("string").alias("aspect"), lit(first).cast("int").alias("first"), lit(last).cast("int").alias("last"))


OTHER = lambda: _out("other")


def _shown(path: Column, first=None, last=None) -> Column:
    """A file's text is read; the system's release file, a package's notes and logs are told apart."""
    package = F.regexp_extract(path, r"node_modules/((?:@[^/]+/)?[^/]+)/", 1)
    notes = (package != "") & F.contains(F.lower(base(path)), F.lit("readme"))
    log = F.endswith(path, F.lit(".log")) | F.startswith(path, F.lit("/var/log/"))
    return (
        F.when(F.endswith(path, F.lit("os-release")), _out("toolchain", "os-release", "os")).when(notes, _out("docs", package))
        .when(log, _out("service", path, "log")).otherwise(_out("read", path, first=first, last=last))
    )


def _patterns(args: Column, plain: Column) -> Column:
    """Every pattern that a search is given: those of -e and --regexp, else the first plain word."""
    marked = F.filter(F.transform(args, lambda x, i: F.when((i > 0) & F.get(args, i - 1).isin("-e", "--regexp"), x).when(x.startswith("--regexp="), F.substr(x, F.lit(10)))), lambda x: x.isNotNull())
    return F.when(F.size(marked) > 0, marked).otherwise(F.slice(plain, 1, 1))


def _texts(word: Column, args: Column, patterns: Column) -> Column:
    """What the patterns look for: each whole, and each branch of its alternatives, without escapes; fixed strings as they are."""
    flags = F.array_join(F.filter(args, lambda x: F.rlike(x, F.lit("^-[A-Za-z]+$"))), "")
    extended = F.contains(flags, F.lit("E")) | F.contains(flags, F.lit("P")) | word.isin("egrep", "rg", "ag")
    branches = lambda p: F.when(extended, F.split(p, r"(?<!\\)\|")).otherwise(F.split(p, r"\\\|"))
    every = F.flatten(F.transform(patterns, lambda p: F.concat(F.array(p), branches(p))))
    free = F.array_distinct(F.filter(F.transform(every, lambda x: F.regexp_replace(x, r"(?s)\\(.)", "$1")), lambda x: x != ""))
    return F.when(F.contains(flags, F.lit("F")) | (word == "fgrep"), patterns).otherwise(free)


@dataclass(frozen=True)
class Seen:
    """The columns that rules look at: one simple command and the later stages of its pipe."""

    word: Column
    args: Column
    plain: Column
    argv: Column
    stages: Column
    heredoc: Column
    searches: Column
    found: Column
    texts: Column
    names: Column

    @property
    def first(self) -> Column:
        return F.get(self.plain, F.lit(0))

    def has(self, *options: str) -> Column:
        return _has(self.args, *options)

    def starts(self, *words: str) -> Column:
        return _starts(self.args, *words)

    def programs(self) -> Column:
        return F.transform(self.stages, _program)

    def any(self) -> Column:
        return F.size(self.plain) > 0


def _case(*branches: tuple[Column, Column]) -> Column:
    """The first branch whose condition is true; other where none is."""
    out = OTHER()
    for when, then in reversed(branches):
        out = F.when(F.coalesce(when, F.lit(False)), then).otherwise(out)
    return out


def _if(when: Column, then: Column) -> Column:
    return _case((when, then))


def _number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^(\d+)$", 1), F.lit("")).cast("int")


def _head_tail(s: Seen) -> Column:
    bytes_ = s.has("-c") | _any(s.args, r"^(-c\d+|--bytes(=.*)?)$")
    short = F.regexp_extract(F.try_element_at(F.filter(s.args, lambda x: F.rlike(x, F.lit(r"^-n?\d+$"))), F.lit(-1)), r"(\d+)", 1).cast("int")
    count = F.when(s.word == "head", F.coalesce(F.when(_any(s.args, r"^-n?\d+$"), short), _number(_after(s.args, "-n", "--lines")), F.lit(10)))
    follows = (s.word == "tail") & s.has("-f", "-F", "--follow")
    return _case((~s.any(), OTHER()), (follows, _out("service", s.first, "log")), (bytes_, _out("peek", s.first, F.when(s.word == "head", "bytes").otherwise(""))), (F.lit(True), _shown(s.first, F.when(s.word == "head", 1), count)))


def _sed(s: Seen) -> Column:
    script = F.coalesce(_after(s.args, "-e"), s.first)
    range_ = lambda g: F.regexp_extract(script, r"^(\d+)(?:,(\d+|\$))?p$", g)
    file = F.get(F.filter(s.plain, lambda x: x != script), F.lit(0))
    last = F.when(range_(2) == "", range_(1)).when(range_(2) != "$", range_(2)).cast("int")
    ok = s.has("-n") & ~_any(s.args, "^(-i|--in-place)") & (range_(1) != "") & file.isNotNull()
    return _if(ok, _shown(file, F.nullif(range_(1), F.lit("")).cast("int"), last))


def _data(s: Seen) -> Column:
    scripted = s.word.isin(*SCRIPTED)
    file = F.when(scripted, F.get(s.plain, F.lit(1))).otherwise(s.first)
    lines = (s.word == "wc") & (F.size(s.plain) == 1) & (F.filter(s.args, lambda x: x.startswith("-")) == F.array(F.lit("-l")))
    keys = (s.word == "jq") & F.regexp_replace(s.first, " ", "").isin("keys", "keys_unsorted", ".|keys", ".|keys_unsorted")
    return _if(file.isNotNull(), _out("peek", file, F.when(lines, "lines").when(keys, "keys").otherwise("")))


def _bytes(s: Seen) -> Column:
    onward = F.forall(s.programs(), lambda p: p.isin(*HEX, "head"))
    start = s.word.isin(*HEX) & ~s.has("-s", "-j", "--skip-bytes", "-seek") & onward
    return _case((~s.any(), OTHER()), (s.word == "file", _out("peek", s.first, "type", s.plain)), (F.lit(True), _out("peek", s.first, F.when(start, "bytes").otherwise(""))))


def _database(s: Seen) -> Column:
    sql = F.slice(s.plain, F.lit(2), F.greatest(F.size(s.plain) - 1, F.lit(0)))
    text = F.array_join(sql, " ")
    changes = F.rlike(text, F.lit(r"(?i)\b(INSERT|UPDATE|DELETE|CREATE|DROP|ALTER|VACUUM|REPLACE)\b|\.import|\.restore"))
    statements = F.filter(F.transform(F.flatten(F.transform(sql, lambda x: F.split(x, r";|\n"))), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: (x != "") & ~F.rlike(x, F.lit(r"(?i)^\.(headers|mode|width|nullvalue)\b")))
    slice_ = lambda x: F.rlike(x, F.lit(r"(?is)^\.(schema|tables|fullschema)\b|^SELECT\b.*\bFROM\s+sqlite_(master|schema)\b|^SELECT\b.*\bLIMIT\s+\d+\s*$")) & ~F.rlike(x, F.lit(r"(?i)\b(EXPLAIN|COUNT|SUM|AVG|MIN|MAX|GROUP_CONCAT|GROUP\s+BY|JOIN|DISTINCT)\b"))
    return _if(s.any() & ~changes & ~s.heredoc, _out("peek", s.first, F.when((F.size(statements) > 0) & F.forall(statements, slice_), "schema").otherwise("")))


def _search(s: Seen) -> Column:
    return _if(F.size(s.found) > 0, _out("search", F.get(s.found, F.lit(0)), "", s.texts))


def _find(s: Seen) -> Column:
    """A search of what is found, by -exec or xargs; else a listing by name, path or kind."""
    given = lambda *o: F.filter(F.transform(s.args, lambda x, i: F.when((i > 0) & F.get(s.args, i - 1).isin(*o) & ~F.coalesce(F.get(s.args, i - 2).isin("-not", "!") & (i > 1), F.lit(False)), F.struct(F.get(s.args, i - 1).alias("option"), x.alias("value")))), lambda x: x.isNotNull())
    kinds, name = given("-type"), F.get(given("-name", "-iname", "-path", "-ipath"), F.lit(0))
    runs = base(_executed(s.args))
    folders = (F.size(kinds) > 0) & F.forall(kinds, lambda k: k["value"] == "d")
    return _case(
        (s.has("-delete"), OTHER()), (runs.isNotNull() & ~runs.isin(*SEARCHING, *SHOWING, "ls", "wc", "head", "file", "stat"), OTHER()), (s.searches.isNotNull(), _search(s)),
        (name.isNotNull(), _out("find", name["value"], name["option"])), (F.lit(True), _out("find", "", F.when(folders, "-type d").otherwise(""))),
    )


def _executed(args: Column) -> Column:
    return _after(args, "-exec", "-execdir")


def _searching(word: Column, argv: Column, args: Column, handed: Column) -> Column:
    """The words of the search that a command makes: its own, the one that find runs, or the one behind xargs; null for none."""
    after = F.slice(args, F.greatest(F.array_position(args, "-exec"), F.array_position(args, "-execdir")).cast("int") + 1, F.size(args))
    given = F.get(F.filter(handed, lambda x: F.coalesce(base(F.get(x, F.lit(0))).isin(*SEARCHING), F.lit(False))), F.lit(0))
    found = F.when(base(_executed(args)).isin(*SEARCHING), after).when(_executed(args).isNull(), given)
    return F.when(word.isin(*SEARCHING), argv).when(word.isin("find", "fd"), found)


def _handed(stage: Column) -> Column:
    """The command that an xargs stage runs, ["echo"] where it names none; null for other stages."""
    words = F.slice(stage["argv"], F.lit(2), F.greatest(F.size(stage["argv"]) - 1, F.lit(0)))
    taking = F.array(*map(F.lit, TAKING["xargs"].split()))
    after = lambda i: (i > 0) & F.coalesce(F.array_contains(taking, F.get(words, i - 1)), F.lit(False))
    at = F.array_min(F.filter(F.transform(words, lambda x, i: F.when(~x.startswith("-") & ~after(i), i)), lambda x: x.isNotNull()))
    return F.when(_program(stage) == "xargs", F.when(at.isNull(), F.array(F.lit("echo"))).otherwise(F.slice(words, at + 1, F.size(words))))


def _names(stages: Column) -> Column:
    """Names that a listing is filtered by: the texts of the searches behind it."""
    taking = F.array(*map(F.lit, TAKING["grep egrep fgrep rg ag ack zgrep"].split()))

    def of(stage: Column) -> Column:
        args = F.slice(stage["argv"], F.lit(2), F.greatest(F.size(stage["argv"]) - 1, F.lit(0)))
        return F.when(_program(stage).isin(*SEARCHING), F.filter(_texts(_program(stage), args, _patterns(args, _plain(args, taking))), lambda x: ~F.contains(x, F.lit("|")))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(stages, of))


def _installed(s: Seen, named: Column) -> Column:
    names = F.when(F.size(named) > 0, named).otherwise(s.names)
    return _out("toolchain", F.coalesce(F.get(names, F.lit(0)), F.lit("")), "package", names)


def _packages(s: Seen, args: Column) -> Column:
    """An installation of what stands behind `install`, without versions."""
    taking = F.array(*map(F.lit, TAKING["pip pip3 uv conda poetry apt-get apt apk yum dnf"].split()))
    behind = F.slice(args, F.array_position(args, "install").cast("int") + 1, F.size(args))
    names = F.transform(_plain(behind, taking), lambda x: F.regexp_extract(x, r"^[^=<>!~\[;]*", 0))
    return _if(F.size(names) > 0, _out("install", F.get(names, F.lit(0)), "", names))


def _rest(c: Column, n: int = 2) -> Column:
    return F.slice(c, F.lit(n), F.greatest(F.size(c) - n + 1, F.lit(0)))


def _pip(s: Seen, args: Column | None = None) -> Column:
    args = F.when((s.word == "uv") & s.starts("pip"), _rest(s.args)).otherwise(s.args) if args is None else args
    none = F.array().cast("array<string>")
    return _case((F.array_contains(args, "install"), _packages(s, args)), (_starts(args, "list", "show", "freeze"), _installed(s, _plain(_rest(args), none))))


def _apt(s: Seen) -> Column:
    none = F.array().cast("array<string>")
    asked = ((s.word == "dpkg") & s.starts("-l", "-s", "--list", "--status")) | ((s.word == "dpkg-query") & s.has("-W")) | ((s.word == "apt") & s.starts("list"))
    return _case(
        (s.has("install") & s.word.isin("apt-get", "apt", "apk", "yum", "dnf"), _packages(s, s.args)), ((s.word == "dpkg") & s.has("-i"), OTHER()), (asked, _installed(s, _plain(_rest(s.args), none))),
        (s.word.isin("apt-cache", "dpkg", "dpkg-query") | s.starts("show", "policy", "search"), _out("toolchain", "", "other")),
    )


def _npm(s: Seen) -> Column:
    second = F.get(s.args, F.lit(1))
    return _case((s.starts("test") | (s.starts("run") & (second == "test")), _out("check", "npm test")), (s.starts("view", "info", "show") & second.isNotNull(), _out("docs", second)), (s.starts("ls", "list"), _out("toolchain", "", "other")))


def _run(s: Seen) -> Column:
    return _if(s.any(), _out("run", s.first))


def _node(s: Seen) -> Column:
    code = _after(s.args, "-e", "--eval", "-p", "--print")
    module = F.regexp_extract(code, rf"require\({_QUOTE}([^'\"]+){_QUOTE}\)", 1)
    asks = (module != "") & F.rlike(code, F.lit(r"Object\.keys|typeof|console\.log\(require")) & (F.length(code) < 200)
    return _case((asks, _out("docs", module)), (code.isNotNull(), OTHER()), (F.lit(True), _run(s)))


def _python(s: Seen) -> Column:
    module, code = _after(s.args, "-m"), _after(s.args, "-c")
    behind = F.slice(s.args, F.array_position(s.args, "-m").cast("int") + 2, F.size(s.args))
    none = F.array().cast("array<string>")
    statement = F.regexp_replace(F.split_part(code, F.lit(";"), F.lit(1)), r"^\s+|\s+$", "")
    listed = F.transform(F.split(F.regexp_replace(statement, "^import", ""), ","), lambda x: F.regexp_extract(x, r"^\s*([^\s.]+)", 1))
    modules = F.when(F.startswith(statement, F.lit("from")), F.array(F.regexp_extract(statement, r"^from\s+([^\s.]+)", 1))).otherwise(F.filter(listed, lambda x: x != ""))
    loaded = F.regexp_extract(code, LOADING, 1)
    imported = F.regexp_extract(code, r"(?:^|;|\n)\s*(?:import|from)\s+(\w+)", 1)
    asks = F.rlike(code, F.lit(r"\binspect\.(signature|getsource|getmembers)|\bhelp\(|\bdir\(|\b__doc__|\b__all__")) & (F.length(code) < 400) & (imported != "")
    page = F.get(_plain(F.coalesce(behind, none), none), F.lit(0))
    return _case(
        (s.heredoc | s.has("-"), OTHER()), (module.isin("pytest", "unittest"), _out("check", module)), (module == "pip", _pip(s, behind)), (module == "pydoc", _if(page.isNotNull(), _out("docs", page))), (module.isNotNull(), OTHER()),
        (F.rlike(code, F.lit(IMPORTING)), _out("toolchain", F.get(modules, F.lit(0)), "module", modules)), (F.rlike(code, F.lit(SAVING)), OTHER()), (loaded != "", _out("peek", loaded)), (asks, _out("docs", imported)), (code.isNotNull(), OTHER()),
        (F.lit(True), _run(s)),
    )


def _http(s: Seen) -> Column:
    saves = s.has("-o", "-O", "--output") & ~s.has("/dev/null")
    local = r"(?:localhost|127\.0\.0\.1|0\.0\.0\.0)(?::(\d{2,5}))?"
    port = lambda u: F.regexp_extract(F.regexp_replace(u, r"^\w+://", ""), rf"^{local}", 1)
    hosts = F.filter(s.plain, lambda u: F.rlike(F.regexp_replace(u, r"^\w+://", ""), F.lit(rf"^{local}|^:\d{{2,5}}\b")))
    near = F.get(hosts, F.lit(0))
    bare = F.regexp_extract(near, r"^:(\d{2,5})", 1)
    sends = s.has("-X", "--request", "-d", "--data", "--data-raw", "--data-binary", "-F", "--form", "-T")
    return _if(~sends & ~saves & near.isNotNull(), _out("service", F.when(port(near) != "", port(near)).when(bare != "", bare).otherwise("80"), "port"))


def _service(s: Seen) -> Column:
    return _case(*[((s.word == p) & (s.has(*flags.split()) if flags else F.lit(True)), _out("service", name, "name")) for p, (name, flags) in SERVICES.items()])


def _which(s: Seen) -> Column:
    plain = F.when(s.word == "command", _plain(_rest(s.args), F.array().cast("array<string>"))).otherwise(s.plain)
    return _if((F.size(plain) > 0) & ((s.word != "command") | s.starts("-v", "-V")), _out("toolchain", F.get(plain, F.lit(0)), "program", plain))


#: Programs -> what their arguments say, in the order of the survey's table.
RULES: tuple[tuple[Sequence[str], Callable[[Seen], Column]], ...] = (
    (SHOWING, lambda s: _case((~s.any(), OTHER()), ((s.word == "cat") & _any(s.args, "^-[A-Za-z]*[AvEeTt][A-Za-z]*$"), _out("peek", s.first)), (F.lit(True), _shown(s.first)))),
    (("head", "tail"), _head_tail), (("sed",), _sed), ((*SCRIPTED, *DATA), _data), (BYTES, _bytes),
    (("pdftotext",), lambda s: _if((F.size(s.plain) == 2) & (F.get(s.plain, F.lit(1)) == "-"), _out("peek", s.first, "pdftext"))),
    (("sqlite3", "duckdb"), _database), (("ls", "tree", "du", "stat"), lambda s: _out("list", F.coalesce(s.first, F.lit(".")))), (SEARCHING, _search), (("find", "fd"), _find),
    (("locate",), lambda s: _if(s.any(), _out("find", s.first))), (("which", "whereis", "type", "hash", "command"), _which),
    (("uname", "lsb_release"), lambda s: _out("toolchain", "os", F.when(s.word == "lsb_release", "os").otherwise("other"))), (("pip", "pip3", "uv", "conda", "poetry"), _pip),
    (("apt-get", "apt", "apt-cache", "dpkg", "dpkg-query", "apk", "yum", "dnf"), _apt), (("npm", "yarn", "pnpm"), _npm), (("node",), _node),
    (INTERPRETERS, lambda s: _if(~s.heredoc & ~s.has("-c", "-e", "-"), _run(s))), (("pytest", "py.test", "tox", "nosetests"), lambda s: _out("check", F.when(s.word == "py.test", "pytest").otherwise(s.word))),
    (("make",), lambda s: _out("check", "make")), (("cargo", "go", "ctest", "mvn", "gradle", "dotnet"), lambda s: _if((s.word == "ctest") | F.array_contains(F.slice(s.args, 1, 2), "test"), _out("check", F.concat(s.word, F.lit(" test"))))),
    (("curl", "wget", "http"), _http), (tuple(SERVICES), _service), (PROCESSES, lambda s: _if((s.word != "top") | s.has("-b"), _out("service", "processes", "processes"))), (("man", "info", "pydoc", "pydoc3"), lambda s: _if(s.any(), _out("docs", s.first))),
)


def intents(df: DataFrame, keys: Sequence[str], command: str) -> DataFrame:
    """The intent of each first stage of a pipe: keys, place, kind, target, targets, aspect,
    first and last (lines of a partial read), argv (of a run or a check, wrappers included).

    kind is read, peek, list, search, find, toolchain, service, docs, install, run or check;
    neutral for what does nothing worth a step, other for what acts otherwise. A null command
    gives no row.
    """
    rows = simple_commands(df, keys, command).where("part.stage = 0")
    word = F.get(F.col("part.argv"), F.lit(0))
    taking = F.create_map(*[F.lit(x) for k, v in TAKING.items() for p in k.split() for x in (p, v)])
    rows = rows.withColumns({"word": base(word), "args": _rest(F.col("part.argv"))})
    rows = rows.withColumn("plain", _plain(F.col("args"), F.split(F.coalesce(taking[F.when(F.rlike("word", F.lit(r"^python[\d.]*$")), "python").otherwise(F.col("word"))], F.lit("")), " ")))
    searching = F.array(*map(F.lit, TAKING["grep egrep fgrep rg ag ack zgrep"].split()))
    # columns that several rules look at are computed once
    rows = rows.withColumn("handed", F.transform("stages", _handed)).withColumn("searches", _searching(F.col("word"), F.col("part.argv"), F.col("args"), F.col("handed")))
    rows = rows.withColumn("search_args", _rest(F.col("searches"))).withColumn("found", _patterns(F.col("search_args"), _plain(F.col("search_args"), searching)))
    rows = rows.withColumns({"texts": _texts(base(F.get("searches", F.lit(0))), F.col("search_args"), F.col("found")), "names": _names(F.col("stages"))})
    s = Seen(F.col("word"), F.col("args"), F.col("plain"), F.col("part.argv"), F.col("stages"), F.col("part.body").isNotNull(), F.col("searches"), F.col("found"), F.col("texts"), F.col("names"))
    args = s.args
    acts = F.exists("stages", lambda p: _program(p).isin("tee", "sh", "bash") | (F.size(p["outputs"]) > 0)) | F.exists("handed", lambda x: F.coalesce(~base(F.get(x, F.lit(0))).isin(*HARMLESS), F.lit(False)))
    open_ = F.col("part.open") | F.exists("stages", lambda p: p["open"])
    last = F.try_element_at(args, F.lit(-1))
    table = reduce(lambda out, rule: F.when(s.word.isin(*rule[0]), rule[1](s)).otherwise(out), reversed(RULES), F.when(F.rlike(word, F.lit(r"^\.?/")), _out("run", word)).otherwise(OTHER()))
    table = F.when(F.rlike("word", F.lit(r"^python[\d.]*$")), _python(s)).otherwise(table)
    asked = _case(
        (F.col("acts"), OTHER()), (word.isNull(), _out("neutral")), (s.word.isin(*NEUTRAL), _out("neutral")), (_has(args, "--help", "-help") | (args == F.array(F.lit("-h"))), _out("docs", s.word)),
        (last.isin("--version", "-version", "-V", "-dumpversion") | (args == F.array(F.lit("version"))), _out("toolchain", s.word, "program", F.array(s.word))), (F.lit(True), table),
    )
    rows = rows.withColumn("acts", open_ | acts | (F.size("part.outputs") > 0)).withColumn("i", asked)
    i, viewers = F.col("i"), s.programs()
    # a read that ends in a hex viewer shows bytes: the first ones if it starts at the file's start
    at = F.array_min(F.filter(F.transform(viewers, lambda p, k: F.when(p.isin(*HEX), k)), lambda x: x.isNotNull()))
    plain_on = F.forall(F.slice(viewers, at + 1, F.size(viewers)), lambda p: p.isin(*HEX, "head"))
    from_start = (s.word.isin("cat", "head") & (i["first"].isNull() | (i["first"] == 1))) | (i["aspect"] == "bytes")
    seen = F.when(i["kind"].isin("read", "peek") & at.isNotNull(), _out("peek", i["target"], F.when(from_start & plain_on, "bytes").otherwise(""))).otherwise(i)
    typed = F.concat(F.col("part.lead"), F.col("part.argv"))
    done = rows.withColumn("i", seen)
    i = F.col("i")
    return done.select(
        *keys, "place", i["kind"].alias("kind"), F.when(i["kind"] == "check", F.array_join("part.argv", " ")).otherwise(i["target"]).alias("target"), i["targets"].alias("targets"), i["aspect"].alias("aspect"), i["first"].alias("first"), i["last"].alias("last"),
        F.when(i["kind"].isin("run", "check"), typed).alias("argv"),
    )


INFORMING = ("read", "peek", "list", "search", "find", "toolchain", "service", "docs")


def gathering(intents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per command: informs (some part is not neutral, and all such only gather information), neutral (no part does anything)."""
    kind = F.col("kind")
    acting = F.count_if(kind != "neutral")
    return intents.groupBy(*keys).agg(((acting > 0) & (F.count_if(~kind.isin(*INFORMING, "neutral")) == 0)).alias("informs"), (acting == 0).alias("neutral"))
