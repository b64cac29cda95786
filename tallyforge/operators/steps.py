"""Two older classifications of shell steps: what a step is about, and what its time goes to.

The first looks at one simple command, the text of its here-document and the rest of its
pipe. The second also needs the session: running a file is the session's own work when an
earlier step wrote it. Each file name's first writing is joined to the later runs by name,
so no history is carried along a session.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shells import base, simple_commands

Branch = tuple[Column, str, str]

#: Programs by what they are about.
ABOUT = {
    ("neutral", "shell"): "cd pushd popd export set source . sleep clear true unset trap local shopt alias exit return seq yes expr bc let read",
    ("info", "env.system"): "mount pkg-config postconf locale getent ip ifconfig uname nproc free df lscpu env printenv id whoami hostname pwd ulimit date arch lsb_release getconf umask tty ldconfig",
    ("act", "process.control"): "kill pkill killall", ("act", "write.file"): "mkdir cp mv rm touch chmod chown ln tar unzip gunzip zip truncate install rmdir dd patch tee",
    ("info", "env.tool"): "which whereis type command hash", ("info", "api.help"): "man info help", ("info", "file.exists"): "test [ [[", ("info", "file.list"): "ls tree du stat realpath readlink dirname basename",
    ("info", "file.search"): "grep egrep fgrep rg ag ack zgrep", ("info", "file.compare"): "diff cmp md5sum sha256sum sha1sum cksum", ("info", "data.inspect"): "awk gawk cut sort uniq jq yq column tr strings xmllint wc xargs",
    ("info", "data.bytes"): "od xxd hexdump file identify exiftool readelf objdump nm size mediainfo ffprobe pdfinfo", ("act", "test"): "pytest py.test tox nosetests unittest",
}
PACKAGES, PYTHON_PACKAGES, NODE_PACKAGES = "apt-get apt yum dnf apk brew".split(), "pip pip3 conda uv poetry".split(), "npm npx yarn pnpm".split()
BUILDERS = "cargo go mvn gradle dotnet rustc javac tsc gcc g++ cc clang clang++ make cmake ninja gfortran cobc ghc ld as nasm".split()
WATCHED = "ps pgrep pidof top htop lsof netstat ss jobs fuser systemctl service supervisorctl nc netcat ping dig nslookup host".split()
PAGERS = "cat head tail less more nl tac zcat bat".split()
DATABASES, DAEMONS = "sqlite3 psql mysql duckdb redis-cli mongo mongosh".split(), "nginx apache2 httpd apachectl redis-server mysqld postgres php-fpm gunicorn uvicorn flask postfix sshd cron".split()
LANGUAGES = r"^(python[\d.]*|node|perl|ruby|php|bash|sh|Rscript|julia|lua|java|deno|bun)$"


def _view(df: DataFrame, keys: Sequence[str], command: str) -> DataFrame:
    """Simple commands with word, text (their words again), code (inline code or here-document), writes and later programs."""
    rows = simple_commands(df, keys, command)
    argv = F.col("part.argv")
    code = F.when(F.array_position(argv, "-c") > 0, F.get(argv, F.array_position(argv, "-c").cast("int"))).when(F.array_position(argv, "-e") > 0, F.get(argv, F.array_position(argv, "-e").cast("int")))
    return rows.withColumns(
        {
            "cmd": F.coalesce(F.get(argv, F.lit(0)), F.lit("")), "word": F.coalesce(base(F.get(argv, F.lit(0))), F.lit("")), "text": F.array_join(argv, " "), "args": F.slice(argv, F.lit(2), F.greatest(F.size(argv) - 1, F.lit(0))),
            "code": F.coalesce("part.body", code), "writes": F.size("part.outputs") > 0, "later": F.transform("stages", lambda p: base(F.get(p["argv"], F.lit(0)))),
        }
    )


def _first(*branches: Branch) -> Column:
    """struct(kind, category) of the first branch that is true."""
    out = F.lit(None).cast("struct<kind:string,category:string>")
    for when, kind, category in reversed(branches):
        out = F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(kind).alias("kind"), F.lit(category).alias("category"))).otherwise(out)
    return out


def abouts(df: DataFrame, keys: Sequence[str], command: str) -> DataFrame:
    """(keys, place, kind, category) of each first stage of a pipe: kind is info, act, compute
    or neutral. A pipe that ends in tee, a file or a shell acts, whatever it starts with. A
    program that no rule names acts as other:<program>."""
    rows = _view(df, keys, command).where("part.stage = 0")
    w, text, code, writes = F.col("word"), F.col("text"), F.col("code"), F.col("writes")
    says = lambda p: F.rlike(text, F.lit(p))
    of = lambda *names: w.isin(*names)
    coded = lambda p: F.rlike(code, F.lit(p))
    named = [b for (kind, category), programs in ABOUT.items() for b in [(of(*programs.split()), kind, category)]]
    log = says(r"/var/log|\.log\b|_logs/")
    interpreter = F.rlike(w, F.lit(LANGUAGES))
    saves = r"open\([^)]*['\"][wax]b?['\"]|\.write\(|\.to_csv|json\.dump|fs\.writeFileSync|os\.(remove|rename)|shutil\.|subprocess|torch\.save|np\.save"
    got = _first(
        (F.size("part.argv") == 0, "neutral", "shell"),
        (of("echo", "printf") & writes, "act", "write.file"), ((w == "echo") & says(r"\$\("), "info", "env.var"), (of("echo", "printf") & says(r"\$[A-Z_]{2,}") & ~says(r"\$\?"), "info", "env.var"), (of("echo", "printf"), "neutral", "shell"),
        ((w == "tar") & says(r"\s-?t[vzf]*\b"), "info", "file.list"), ((w == "unzip") & says(r"\s-l"), "info", "file.list"), ((w == "date") & says(r"\s-s\b"), "act", "process.control"),
        (of("cat") & F.col("part.body").isNotNull() & writes, "act", "write.file"), (of("sed", "perl") & says(r"\s-[a-z]*i"), "act", "edit.file"), ((w == "sed"), "info", "file.read"),
        (of(*PACKAGES) & says(r"\b(list|search|show|policy|info)\b") & ~says(r"\binstall\b"), "info", "env.packages"), (of(*PACKAGES), "act", "install"),
        ((w == "dpkg") & says(r"\s-i\b"), "act", "install"), (of("apt-cache", "dpkg", "dpkg-query", "rpm"), "info", "env.packages"),
        ((of(*PYTHON_PACKAGES) | says(r"^\S*python[\d.]*\s+-m\s+pip\b")) & says(r"\b(list|show|freeze|check|index)\b|--version|-V\b") & ~says(r"\binstall\b"), "info", "env.packages"), (of(*PYTHON_PACKAGES) | says(r"^\S*python[\d.]*\s+-m\s+pip\b"), "act", "install"),
        (of(*NODE_PACKAGES) & says(r"\b(ls|list|view|info|search|show|outdated|root|config get)\b|--version|\s-v\b") & ~says(r"\b(install|i|add|ci)\b"), "info", "env.packages"), (of(*NODE_PACKAGES) & says(r"\b(test|run\s+test)\b"), "act", "test"),
        (of(*NODE_PACKAGES) & (says(r"\b(run|start|exec)\b") | (w == "npx")), "act", "run"), (of(*NODE_PACKAGES), "act", "install"),
        (of(*BUILDERS) & says(r"--version|\s-v$|\s-V$|\s-dumpversion|--help") & ~says(r"\s-o\s"), "info", "env.tool"), ((of("cargo", "go", "dotnet") & says(r"\btest\b")) | ((w == "make") & says(r"\b(test|check)\b")), "act", "test"), (of(*BUILDERS), "act", "build"),
        (says(r"\s(--version|-version|-V)\s*$"), "info", "env.tool"), (says(r"\s(--help|-h|-help)\b"), "info", "api.help"),
        (of("systemctl", "service", "supervisorctl") & ~says(r"\b(status|is-active|list)\b|--status-all"), "act", "service.control"), (of("nc", "netcat") & says(r"\s-l"), "act", "service.control"), (of(*WATCHED), "info", "service.check"),
        (of("curl", "wget", "http") & says(r"localhost|127\.0\.0\.1|0\.0\.0\.0|:\d{2,5}/") & ~says(r"\s-o\s+(?!/dev/null)\S") & ~says(r"-X\s*(POST|PUT|DELETE)|--data|\s-d\s"), "info", "service.check"),
        (of("curl", "wget", "http") & says(r"\s-[sSfL]*I\b|--head"), "info", "net.check"), (of("curl", "wget", "http"), "act", "download"),
        ((w == "git") & says(r"\b(status|log|diff|show|branch|remote|ls-files|rev-parse|blame|describe)\b") & ~says(r"\b(clone|checkout|pull|fetch|reset|commit|apply)\b"), "info", "git.state"), ((w == "git"), "act", "git.change"),
        (of("find", "locate", "fd") & says(r"-delete|-exec\s+(rm|mv|cp|chmod|sed)\b"), "act", "write.file"),
        (of("find", "locate", "fd") & (says(r"-exec\s+(grep|cat|head|ls|wc)\b") | F.exists("stages", lambda p: F.rlike(F.array_join(p["argv"], " "), F.lit(r"^xargs\s.*\bgrep\b")))), "info", "file.search"), (of("find", "locate", "fd"), "info", "file.find"),
        (of(*PAGERS, "sort", "uniq", "cut", "awk", "gawk", "tr", "jq", "column", "strings", "paste") & writes, "act", "write.file"), ((w == "tail") & says(r"\s-f\b"), "info", "logs"), (of("tail", "cat", "head") & log, "info", "logs"),
        (of(*PAGERS) & says(r"\s-c\s*\d"), "info", "data.bytes"), (of(*PAGERS) & says(r"node_modules|site-packages|/usr/(lib|share|include)|dist-packages|\.d\.ts|README"), "info", "api.source"), (of(*PAGERS, "fold", "paste", "comm"), "info", "file.read"),
        (of("pdftotext", "tesseract", "pdftoppm") & says(r"\s-$"), "info", "data.extract"), (of("pdftotext", "tesseract", "pdftoppm"), "act", "run"),
        (of(*DATABASES) & (F.length(text) > 350), "act", "run"), (of(*DATABASES) & says(r"(?i)\b(INSERT|UPDATE|DELETE|CREATE|DROP|ALTER|VACUUM)\b|\.import|\.restore"), "act", "write.db"),
        (of(*DATABASES) & says(r"(?i)\.(schema|tables|indexes|indices)|PRAGMA|EXPLAIN|sqlite_master|information_schema"), "info", "data.schema"), (of(*DATABASES) & F.col("part.input"), "act", "run"), (of(*DATABASES), "info", "data.query"),
        (of(*DAEMONS) & says(r"\s-t\b|\s-T\b|configtest|-V|-v$"), "info", "service.config_test"), (of(*DAEMONS), "act", "service.control"), (says(r"\s-m\s+(pytest|unittest)\b"), "act", "test"),
        (interpreter & code.isNotNull() & coded(r"^\s*(import|from)\s+[\w., ]+(\s+import\s+[\w., *]+)?\s*(;\s*print\([^)]*\))?\s*;?\s*$"), "info", "env.packages"),
        (interpreter & code.isNotNull() & coded(r"\binspect\.(signature|getsource)|\bhelp\(|\bdir\(|__doc__|__file__|__version__|\.__all__|Object\.keys|typeof") & (F.length(code) < 400), "info", "api.probe"),
        (interpreter & code.isNotNull() & coded(saves), "act", "script.writes"), (interpreter & code.isNotNull() & coded(r"(?m)^\s*(from|import)\s+(run|model|solution|main|app|cli\w*|\w*_tool)\b"), "compute", "script.own_code"), (interpreter & (code.isNotNull() | says(r"\s-$")), "compute", "script.inline"),
        (of("bash", "sh") & says(r"\.sh\b"), "act", "run"), (interpreter & says(r"\b(test_\w+|tests?/)"), "act", "test"), (interpreter & says(r"-m\s+http\.server"), "act", "service.control"), (interpreter & (F.size("args") == 0), "neutral", "shell"), (interpreter, "act", "run"),
        *named, (F.rlike("cmd", F.lit(r"^(\./|/)")), "act", "run"),
    )
    tail = F.exists("stages", lambda p: (base(F.get(p["argv"], F.lit(0))) == "tee") | (F.size(p["outputs"]) > 0))
    shells = F.arrays_overlap("later", F.array(F.lit("sh"), F.lit("bash")))
    out = rows.withColumn("got", F.coalesce(got, F.struct(F.lit("act").alias("kind"), F.concat(F.lit("other:"), w).alias("category"))))
    info = F.col("got.kind") == "info"
    return out.select(*keys, "place", F.when(info & (tail | F.coalesce(shells, F.lit(False))), "act").otherwise(F.col("got.kind")).alias("kind"), F.when(info & tail, "write.file").when(info & F.coalesce(shells, F.lit(False)), "run").otherwise(F.col("got.category")).alias("category"))


#: Programs by what a step's time goes to.
SPENT = {
    "neutral": "cd export set source . unset : true false shopt trap exit return local pushd popd clear reset read let eval", "wait": "sleep ps pgrep pidof jobs wait watch top htop nvidia-smi lsof netstat ss fuser inotifywait",
    "write": "patch ed ex truncate dd vi vim nano emacs", "tests": "pytest py.test tox nox ctest prove rspec jest mocha vitest phpunit busted bats mypy pyflakes flake8 pylint ruff shellcheck eslint",
    "information": "ls cat head tail less more grep egrep fgrep rg find fd file stat wc du df which whereis type tree sort uniq cut tr awk gawk sed diff cmp md5sum sha256sum od xxd hexdump strings readelf objdump nm jq env printenv uname date id whoami hostname pwd free nproc lscpu man locate zcat nl tac comm paste getent identify pdfinfo pdftotext exiftool apt-cache dpkg dpkg-query base64 expr bc test sqlite3 psql mysql service systemctl command",
    "other": "wget scp rsync aria2c mkdir cp mv rm chmod chown touch ln tar unzip gzip gunzip zip xz bzip2 install rmdir mktemp split kill pkill killall",
}
COMPILERS = "gcc g++ cc c++ clang clang++ rustc javac ocamlc nvcc ghc cobc gfortran nasm as ld tsc".split()
BUILDS = "make cmake ninja cargo go mvn gradle dune meson bazel npm yarn pnpm npx configure".split()
TESTED = r"(?i)(^|[/_.-])(test|tests|check|checks|verify|validate|validation|grade|grader|eval)([/_.-]|s?$)"


def timed(df: DataFrame, session: Sequence[str], turn: str, command: str) -> DataFrame:
    """(session, turn, place, kind, ran) of every simple command: neutral, write, install,
    information, wait, tests, inline, run own, run other or other. `ran` is the file that a
    run runs or compiles. A run is own when a step before it in the session, in the order of
    (turn, place), wrote a file of that name; a build is own once anything was written.

    Turns that are alike in number are one command line after the other as they come; rows
    with a null session or turn are sessions and turns of their own and own no files.
    """
    keys = [*session, turn]
    rows = _view(df, keys, command)
    w, args, text, outputs = F.col("word"), F.col("args"), F.col("text"), F.col("part.outputs")
    says = lambda p: F.rlike(text, F.lit(p))
    of = lambda *names: w.isin(*names)
    files = F.filter(args, lambda x: ~x.startswith("-"))
    last = F.try_element_at(files, F.lit(-1))
    interpreter = F.rlike(w, F.lit(LANGUAGES))
    script = F.coalesce(F.when(F.array_position(args, "-m") > 0, F.get(args, F.array_position(args, "-m").cast("int"))), F.get(files, F.lit(0)))
    module = F.array_position(args, "-m") > 0
    inline = F.col("code").isNotNull() | F.col("part.input") | (F.get(args, F.lit(0)) == "-")
    edits = of("sed", "perl") & F.exists(args, lambda x: F.rlike(x, F.lit("^-[a-zA-Z]*i")))
    prints = of("echo", "printf", "cat", *"sed awk gawk perl sort".split()) & F.col("writes")
    managers = of(*PACKAGES, *PYTHON_PACKAGES, *"npm yarn pnpm cargo go gem opam".split())
    verbs = F.get(args, F.lit(0)).isin("install", "add", "i", "get", "update", "upgrade", "download", "sync", "build-dep", "uninstall")
    spent = {k: v.split() for k, v in SPENT.items()}
    log = F.rlike(F.coalesce(last, F.lit("")), F.lit(r"(?i)log[^/]*(\.txt)?$|\.(out|err)$"))
    kind = (
        F.when(F.size("part.argv") == 0, "neutral").when(of("echo", "printf", "true", "false", "test", "[", "[[", "read") & ~F.col("writes"), "neutral")
        .when((F.col("part.stage") > 0) & of(*spent["information"]) & ~F.col("writes") & ~of("sed", "awk", "perl"), "neutral").when(prints | edits, "write")
        .when((w == "tee") & ((F.col("part.stage") > 0) | F.col("part.body").isNotNull()) & (F.size(files) > 0), "write").when((w == "tee"), "neutral").when(of(*spent["write"]) | ((w == "git") & (F.get(args, F.lit(0)) == "apply")), "write")
        .when(managers & verbs, "install").when(interpreter & says(r"\s-m\s+(pip|ensurepip|venv|virtualenv)\b") & ~says(r"pip\s+(list|show|freeze|check)\b"), "install").when(interpreter & says(r"\s-m\s+pip\b"), "information")
        .when((w == "dpkg") & says(r"\s(-i|--install)\b"), "install").when(of(*PACKAGES, *PYTHON_PACKAGES), "information")
        .when((F.size(args) <= 2) & F.exists(args, lambda x: x.isin("--version", "-V", "--help", "-h", "-version")), "information").when(of(*spent["wait"]) | ((w == "kill") & (F.get(args, F.lit(0)) == "-0")), "wait")
        .when((w == "tail") & F.exists(args, lambda x: F.rlike(x, F.lit("^(-f|-F|--follow)"))), "wait").when(of("tail", "cat", "head", "less", "grep") & log, "wait")
        .when(of("curl", "wget", "nc", "telnet", "http", "redis-cli") & says(r"localhost|127\.0\.0\.1|0\.0\.0\.0|::1"), "tests")
        .when((w == "git") & F.get(args, F.lit(0)).isin(*"log status diff show ls-files branch rev-parse cat-file ls-tree reflog remote config describe rev-list shortlog blame grep tag help".split()), "information").when((w == "git"), "other")
        .when((w == "tar") & says(r"^\S+\s+-?[a-zA-Z]*t"), "information").when((w == "unzip") & says(r"\s-l\b"), "information").when(of(*spent["information"]), "information").when(of(*spent["tests"]), "tests")
        .when(interpreter & says(r"\s-m\s+(pytest|unittest|doctest|py_compile|compileall|mypy|pyflakes|flake8|pylint|ruff)\b"), "tests").when(of(*BUILDS) & says(r"\b(test|check|tests|vet|clippy|lint)\b"), "tests").when(of("bash", "sh") & F.array_contains(args, "-n"), "tests")
        .when(interpreter & F.rlike("code", F.lit(r"^\s*((import [\w., ]+|from [\w.]+ import [\w., *]+);?\s*)*(print\([^;]*\)\s*;?\s*)*$")) & (F.length("code") <= 200) & F.col("part.body").isNull(), "information").when(interpreter & inline & ~module, "inline")
        .when((interpreter | F.contains("cmd", F.lit("/"))) & F.rlike(F.when(interpreter, base(script)).otherwise(w), F.lit(TESTED)) & ~module, "tests")
        .when(interpreter | of(*COMPILERS), "run").when(of(*BUILDS), "build").when(F.contains("cmd", F.lit("/")) | F.startswith("cmd", F.lit(".")), "run").when(of(*spent["other"]) | (w == "curl"), "other").when(of(*spent["neutral"]), "neutral").otherwise("run")
    )
    rows = rows.withColumn("kind", kind)
    run, none = F.col("kind") == "run", F.array().cast("array<string>")
    ran = F.when(run & interpreter & module, F.array(F.concat(F.split_part(script, F.lit("."), F.lit(1)), F.lit(".py")))).when(run & interpreter, F.array(base(script))).when(run & of(*COMPILERS), F.transform(F.filter(args, lambda x, i: ~x.startswith("-") & ~F.coalesce(F.get(args, i - 1) == "-o", F.lit(False))), base)).when(run, F.array(w)).otherwise(none)
    opened = F.regexp_extract_all(F.coalesce("code", F.lit("")), F.lit(r"open\(\s*[rf]?['\"]([^'\"]+)['\"]\s*,\s*['\"][wax]"), F.lit(1))
    made = (
        F.when((F.col("kind") == "write") & (w == "tee"), files).when((F.col("kind") == "write") & edits, F.array(last)).when(F.col("kind") == "write", outputs).when((F.col("kind") == "inline") | interpreter, opened)
        .when(of(*COMPILERS) & (F.array_position(args, "-o") > 0), F.array(F.get(args, F.array_position(args, "-o").cast("int")))).when(of("cp", "mv") & last.isNotNull(), F.array(last)).otherwise(none)
    )
    rows = rows.select(*keys, "place", "kind", F.filter(ran, lambda x: x.isNotNull()).alias("ran"), F.transform(F.filter(made, lambda x: x.isNotNull()), base).alias("made"))
    at = F.struct(F.col(turn).alias("turn"), F.col("place").alias("place"))
    first = rows.select(*session, F.explode("made").alias("file"), at.alias("at")).groupBy(*session, "file").agg(F.min("at").alias("written_at"))
    begun = first.groupBy(*session).agg(F.min("written_at").alias("begun_at"))
    runs = rows.select(*keys, "place", F.explode("ran").alias("file")).join(first, [*session, "file"]).where(F.col("written_at") < at)
    own = runs.groupBy(*keys, "place").agg(F.lit(True).alias("own"))
    out = rows.join(own, [*keys, "place"], "left").join(begun, list(session), "left")
    built = (F.col("kind") == "build") & F.coalesce(F.col("begun_at") < at, F.lit(False))
    final = F.when(F.col("own") | built, "run own").when(F.col("kind").isin("run", "build"), "run other").otherwise(F.col("kind"))
    return out.select(*keys, "place", final.alias("kind"), F.get("ran", F.lit(0)).alias("ran"))
