"""Shell commands taken apart, and what their parts are for."""

import shlex

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.functions.shell import parts
from tallyforge.operators import shells, steps

WORDS = st.lists(st.text(st.sampled_from(list("ab -;|&<>()'\"\\$`#\n=*é")), min_size=1, max_size=8), min_size=1, max_size=5)


@settings(max_examples=400, deadline=None)
@given(WORDS, st.sampled_from(["", " 2>/dev/null", " > out", " # a note", " 2>&1", " <<< x"]))
def test_quoted_words_come_back(words, ending):
    words = ["run", *words]
    (p,) = parts(shlex.join(words) + ending)
    assert p["argv"] == words and not p["open"] and p["outputs"] == (["out"] if ending == " > out" else []) and p["input"] == (ending == " <<< x")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(WORDS, st.sampled_from([" | ", "; ", " && ", " || ", " & ", "\n"])), min_size=1, max_size=5))
def test_joined_commands_come_apart(commands):
    text = "".join(shlex.join(["c", *w]) + op for w, op in commands)
    got = parts(text.removesuffix(commands[-1][1]))
    assert [p["argv"] for p in got] == [["c", *w] for w, _ in commands]
    stages, pipe, stage = [], 0, 0
    for _, op in commands:
        stages.append((pipe, stage))
        pipe, stage = (pipe, stage + 1) if op == " | " else (pipe + 1, 0)
    assert [(p["pipe"], p["stage"]) for p in got] == stages


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("ab '\"\\|&;<>(){}$`#\n")), max_size=30))
def test_any_text_ends(text):
    assert isinstance(parts(text), list)


def test_forms():
    of = lambda t: [(p["argv"], p["lead"]) for p in parts(t)]
    assert of("for i in 1 2; do echo $i; done; if grep -q x f; then ls; fi") == [(["echo", "$i"], []), (["grep", "-q", "x", "f"], []), (["ls"], [])]
    assert of("A=1 B='x y' sudo -u me timeout -k 5 60 env C=2 make -j4") == [(["make", "-j4"], ["A=1", "B=x y", "sudo", "-u", "me", "timeout", "-k", "5", "60", "env", "C=2"])]
    assert of("x=$(grep -c 'a|b' f | head -1)") == [(["grep", "-c", "a|b", "f"], []), (["head", "-1"], [])] and of("A=1") == [([], ["A=1"])]
    assert of('echo "$(ls a b)" `date`') == [(["echo", "$(ls a b)", "`date`"], [])] and of("(cd a; ls) 2>/dev/null") == [(["cd", "a"], []), (["ls"], [])]
    two = parts("cat <<'A' > a.txt; cat <<-B | sort > b.txt\nx; y\nA\n\tz | w\n\tB\nls")
    assert [(p["argv"], p["body"], p["outputs"]) for p in two] == [(["cat"], "x; y\n", ["a.txt"]), (["cat"], "\tz | w\n", []), (["sort"], None, ["b.txt"]), (["ls"], None, [])]
    assert parts("cat <<E\nnever ends")[0]["body"] == "never ends" and parts("echo 'open")[0]["open"] and parts("") == [] and parts("# only a note") == []


#: Command -> kind, target, targets, aspect, lines of its first part.
INTENTS = {
    "cat -n main.py | head -80": ("read", "main.py", [], "", (None, None)), "cat -vet f": ("peek", "f", [], "", (None, None)), "cat": ("other", None, [], "", (None, None)), "cat a > b": ("other", None, [], "", (None, None)), "cat f | tee g": ("other", None, [], "", (None, None)),
    "cat f | bash": ("other", None, [], "", (None, None)), "head f": ("read", "f", [], "", (1, 10)), "head -n5 f": ("read", "f", [], "", (1, 5)), "head -7 f": ("read", "f", [], "", (1, 7)), "tail -c 9 f": ("peek", "f", [], "", (None, None)), "tail -F /x/y": ("service", "/x/y", [], "log", (None, None)),
    "sed -n '5p' f": ("read", "f", [], "", (5, 5)), "sed -n '5,$p' f": ("read", "f", [], "", (5, None)), "sed -n -e 2,3p f": ("read", "f", [], "", (2, 3)), "sed 's/a/b/' f": ("other", None, [], "", (None, None)), "cat /etc/os-release": ("toolchain", "os-release", [], "os", (None, None)),
    "cat node_modules/@a/b/README.md": ("docs", "@a/b", [], "", (None, None)), "less /var/log/syslog": ("service", "/var/log/syslog", [], "log", (None, None)), "wc -l a b": ("peek", "a", [], "", (None, None)), "jq '. | keys' f": ("peek", "f", [], "keys", (None, None)), "awk '{print}'": ("other", None, [], "", (None, None)),
    "xxd f | head": ("peek", "f", [], "bytes", (None, None)), "xxd -s 4 f": ("peek", "f", [], "", (None, None)), "xxd f | grep 00": ("peek", "f", [], "", (None, None)), "head -5 f | xxd": ("peek", "f", [], "bytes", (None, None)), "tail f | od -c": ("peek", "f", [], "", (None, None)), "file a b": ("peek", "a", ["a", "b"], "type", (None, None)),
    "pdftotext a.pdf -": ("peek", "a.pdf", [], "pdftext", (None, None)), "pdftotext a.pdf": ("other", None, [], "", (None, None)), "sqlite3 d .schema": ("peek", "d", [], "schema", (None, None)), "sqlite3 d 'select a from t'": ("peek", "d", [], "", (None, None)), "sqlite3 d 'drop table t'": ("other", None, [], "", (None, None)),
    "ls": ("list", ".", [], "", (None, None)), "ls -I x a": ("list", "a", [], "", (None, None)), "egrep 'a|b' f": ("search", "a|b", ["a|b", "a", "b"], "", (None, None)), "grep -F 'a\\.b' f": ("search", "a\\.b", ["a\\.b"], "", (None, None)), "grep 'a\\.b' f": ("search", "a\\.b", ["a.b"], "", (None, None)),
    "grep --regexp=z -m 3 f": ("search", "z", ["z"], "", (None, None)), "grep": ("other", None, [], "", (None, None)), "find . -not -name a -o -iname b": ("find", "b", [], "-iname", (None, None)), "find . -type d": ("find", "", [], "-type d", (None, None)), "find . -exec rm {} +": ("other", None, [], "", (None, None)),
    "find . -exec grep -E 'x|y' {} +": ("search", "x|y", ["x|y", "x", "y"], "", (None, None)), "find . | xargs -n 1 cat": ("find", "", [], "", (None, None)), "find . | xargs sed -i s/a/b/": ("other", None, [], "", (None, None)), "ls | xargs": ("list", ".", [], "", (None, None)), "locate x": ("find", "x", [], "", (None, None)),
    "command -v a b": ("toolchain", "a", ["a", "b"], "program", (None, None)), "command ls": ("other", None, [], "", (None, None)), "uname -a": ("toolchain", "os", [], "other", (None, None)), "lsb_release -a": ("toolchain", "os", [], "os", (None, None)), "uv pip install -r r.txt x": ("install", "x", ["x"], "", (None, None)),
    "pip install -r r.txt": ("other", None, [], "", (None, None)), "pip show a b": ("toolchain", "a", ["a", "b"], "package", (None, None)), "pip freeze": ("toolchain", "", [], "package", (None, None)), "dpkg -l | grep -E 'a|b'": ("toolchain", "a", ["a", "b"], "package", (None, None)), "apt-get update": ("other", None, [], "", (None, None)),
    "apt-cache policy x": ("toolchain", "", [], "other", (None, None)), "dpkg -i x.deb": ("other", None, [], "", (None, None)), "npm run test": ("check", "npm run test", [], "", (None, None)), "npm view x": ("docs", "x", [], "", (None, None)), "npm install": ("other", None, [], "", (None, None)), "node a.js": ("run", "a.js", [], "", (None, None)),
    "node -e 'console.log(require(\"fs\"))'": ("docs", "fs", [], "", (None, None)), "bash -c ls": ("other", None, [], "", (None, None)), "perl a.pl": ("run", "a.pl", [], "", (None, None)), "py.test -q": ("check", "py.test -q", [], "", (None, None)), "time make test": ("check", "make test", [], "", (None, None)), "go build": ("other", None, [], "", (None, None)),
    "curl -d x localhost:1": ("other", None, [], "", (None, None)), "curl -o f localhost:80": ("other", None, [], "", (None, None)), "curl http://127.0.0.1/x": ("service", "80", [], "port", (None, None)), "curl http://a.net": ("other", None, [], "", (None, None)), "nginx -t": ("service", "nginx", [], "name", (None, None)), "nginx": ("other", None, [], "", (None, None)),
    "top": ("other", None, [], "", (None, None)), "top -b": ("service", "processes", [], "processes", (None, None)), "ls --help": ("docs", "ls", [], "", (None, None)), "go version": ("toolchain", "go", ["go"], "program", (None, None)), "python3.11 -c 'from a.b import c'": ("toolchain", "a", ["a"], "module", (None, None)),
    "python -c \"import json; print(json.load(open('d.json')))\"": ("peek", "d.json", [], "", (None, None)), "python -c \"open('x', 'w').write('a')\"": ("other", None, [], "", (None, None)), "python -c 'import a; x = a.__doc__; print(x)'": ("docs", "a", [], "", (None, None)), "python -m pip list": ("toolchain", "", [], "package", (None, None)),
    "python -m http.server": ("other", None, [], "", (None, None)), "python -m pydoc a.b": ("docs", "a.b", [], "", (None, None)), "python a.py": ("run", "a.py", [], "", (None, None)), "python <<E\nprint(1)\nE": ("other", None, [], "", (None, None)), "/opt/x/run --a": ("run", "/opt/x/run", [], "", (None, None)), "foo": ("other", None, [], "", (None, None)),
    "cd x": ("neutral", None, [], "", (None, None)), "A=1": ("neutral", None, [], "", (None, None)), "echo hi > f": ("other", None, [], "", (None, None)), "ls 'x": ("other", None, [], "", (None, None)), "n=$(wc -l f)": ("peek", "f", [], "lines", (None, None)),
}


def test_intents(spark):
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(INTENTS)] + [(-1, None)], "id long, command string")
    got = {r["id"]: r for r in shells.intents(frame, ["id"], "command").where("place = 0").collect()}
    assert {c: (got[i]["kind"], got[i]["target"], got[i]["targets"], got[i]["aspect"], (got[i]["first"], got[i]["last"])) for i, c in enumerate(INTENTS)} == INTENTS
    assert -1 not in got and got[list(INTENTS).index("time make test")]["argv"] == ["time", "make", "test"]
    both = spark.createDataFrame([(1, "cd a && cat f"), (2, "cd a; export B=1"), (3, "cat f; rm g")], "id long, command string")
    assert {r["id"]: (r["informs"], r["neutral"]) for r in shells.gathering(shells.intents(both, ["id"], "command"), ["id"]).collect()} == {1: (True, False), 2: (False, True), 3: (False, False)}


SESSION = [
    ("s", 0, "python a.py; cat > a.py <<'E'\nprint(1)\nE\npython a.py"), ("s", 1, "make"), ("t", 0, "make && gcc -o prog x.c && ./prog"), ("t", 1, "tee b.sh <<E\nls\nE\nbash b.sh | tee log; sh -n b.sh"), ("t", 2, "python - <<E\nopen('c.py', 'w')\nE"), ("t", 3, "python -m c"),
    ("u", 0, "python b.sh"), ("u", 1, "pytest; tail -f x.log; pip install y; pip list; git log; git commit; curl localhost:1; sleep 4; mv p.py q.py; python q.py"), (None, 0, "echo 1 > z.py"), (None, 1, "python z.py"), ("u", 2, None),
]


def test_time_by_session(spark):
    frame = spark.createDataFrame(SESSION, "sid string, turn long, command string").repartition(5)
    got = {}
    for r in sorted(steps.timed(frame, ["sid"], "turn", "command").collect(), key=lambda r: (str(r["sid"]), r["turn"], r["place"])):
        got.setdefault((r["sid"], r["turn"]), []).append(r["kind"])
    assert got == {
        ("s", 0): ["run other", "write", "run own"], ("s", 1): ["run own"], ("t", 0): ["run other", "run other", "run own"], ("t", 1): ["write", "run own", "write", "tests"], ("t", 2): ["inline"], ("t", 3): ["run own"],
        ("u", 0): ["run other"], ("u", 1): ["tests", "wait", "install", "information", "information", "other", "tests", "wait", "other", "run own"], (None, 0): ["write"], (None, 1): ["run other"],
    }


ABOUT = {
    "cat a | sort > b": ("act", "write.file"), "cat a | python3 x": ("info", "file.read"), "cat a | sh": ("act", "run"), "echo $HOME": ("info", "env.var"), "echo a > b": ("act", "write.file"), "tar tzf a.tgz": ("info", "file.list"), "tar xzf a.tgz": ("act", "write.file"),
    "npm run build": ("act", "run"), "npm ci": ("act", "install"), "make check": ("act", "test"), "gcc -o a a.c": ("act", "build"), "systemctl status x": ("info", "service.check"), "systemctl restart x": ("act", "service.control"), "git stash apply": ("act", "git.change"),
    "find . | xargs grep x": ("info", "file.search"), "find . -exec rm {} +": ("act", "write.file"), "sqlite3 d 'PRAGMA x'": ("info", "data.schema"), "sqlite3 d 'insert into t values (1)'": ("act", "write.db"), "sqlite3 d < q.sql": ("act", "run"), "python -c 'import a, b'": ("info", "env.packages"),
    "python <<E\nhelp(x)\nE": ("info", "api.probe"), "python <<E\nopen('x', 'w').write('y')\nE": ("act", "script.writes"), "python <<E\nfrom solution import f\nf()\nE": ("compute", "script.own_code"), "python <<E\nprint(3 * 4)\nE": ("compute", "script.inline"), "python tests/a.py": ("act", "test"), "python": ("neutral", "shell"),
    "bash a.sh": ("act", "run"), "cat site-packages/x.py": ("info", "api.source"), "head -c 5 f": ("info", "data.bytes"), "./a --help": ("info", "api.help"), "frobnicate x": ("act", "other:frobnicate"), "kill 4": ("act", "process.control"), "curl -I http://a.net": ("info", "net.check"), "wget http://a.net/x": ("act", "download"),
}


def test_abouts(spark):
    frame = spark.createDataFrame(list(enumerate(ABOUT)), "id long, command string")
    got = {r["id"]: (r["kind"], r["category"]) for r in steps.abouts(frame, ["id"], "command").where("place = 0").collect()}
    assert {c: got[i] for i, c in enumerate(ABOUT)} == ABOUT


@pytest.mark.parametrize("column", ["word", "args", "text", "kind", "place_"])
def test_keys_of_any_name_stay_apart(spark, column):
    frame = spark.createDataFrame([(1, "ls a")], f"{column} long, command string")
    assert shells.simple_commands(frame, [column], "command").count() == 1
