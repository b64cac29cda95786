"""Classes of failed calls, and wrong paths against a search through the whole history."""

import random
import re

from tallyforge.operators import errors

SCHEMA = "sid string, turn long, command string, output string, code int"


def classes(spark, rows):
    frame = spark.createDataFrame([(s, t, c, o, x) for s, t, c, o, x in rows], SCHEMA).repartition(3)
    return {(r["sid"], r["turn"]): (r["class"], r["detail"]) for r in errors.classified(frame, ["sid"], "turn").collect()}


def test_classes_with_nulls(spark):
    rows = [("a", 0, None, "FAILED x", None), ("a", 1, "", "", 137), ("a", 2, "ls", None, 1), ("a", 3, None, "", None), (None, 0, "cat f", "cat: f: No such file or directory", 1), ("b", None, "cat f", "cat: f: No such file or directory", 1)]
    assert classes(spark, rows) == {("a", 0): ("tests", None), ("a", 1): ("timeout or killed", None), ("a", 3): ("no error text", None), (None, 0): ("missing path", "f"), ("b", None): ("missing path", "f")}


def test_order_of_the_ladder(spark):
    rows = [
        ("s", 0, "curl http://localhost:1", "curl: (7) Connection refused", 7), ("s", 1, "curl http://a.net", "curl: (7) Connection refused", 7), ("s", 2, "python x.py", "Traceback (most recent call last):\n  x\npkg.sub.OddError: parse error", 1), ("s", 3, "x", "parse error near 3", 1),
        ("s", 4, "make", "bash: /opt/x: command not found\nmake: *** Aborted", 2), ("s", 5, "./a b", "bash: ./a: Permission denied", 126), ("s", 6, "sudo ./a b", "mkdir: x: Permission denied", 1), ("s", 7, "cd q && ls", "bash: cd: q: No such file or directory", 1), ("s", 8, "mvn test", "BUILD: 3 tests failed", 1),
        ("s", 9, "git push; rm x", "fatal: no upstream", 128), ("s", 10, "pytest", "== 0 failed, 3 passed ==", 1), ("s", 11, "grep a b | wc", "", 1), ("s", 12, "a", "Traceback (most recent call last):\nKeyboardInterrupt", 1), ("s", 13, "a", "ValueError: no traceback", 1),
    ]
    assert [v for _, v in sorted(classes(spark, rows).items())] == [
        ("local server", None), ("network", None), ("exception", "OddError"), ("syntax", None), ("exception", None), ("no execute permission", "./a"), ("permission", None), ("missing folder", "q"), ("tests", None),
        ("git", None), ("tests", None), ("nothing found", None), ("exception", "KeyboardInterrupt"), ("exception", None),
    ]


def shown_before(path, history):
    """Whether the texts name the file of a missing path in another place, word by word."""
    name, folder = path.split("/")[-1], (path.split("/")[-2:-1] or [""])[0]
    tells = name not in errors.COMMON_NAMES and len(name) >= 3 and ("." in name.strip(".") or len(name) >= 5)
    for seen in {w for text in history for w in re.findall(r"(?<![\w./~-])[\w./~-]*[\w-]", text)}:
        if seen.split("/")[-1] != name or seen == path:
            continue
        if seen == name:
            if tells and "/" in path:
                return True
        elif not path.endswith("/" + seen) and (tells or (folder not in ("", ".", "..", "~") and seen.endswith(f"{folder}/{name}"))):
            return True
    return False


def test_wrong_paths_equal_a_search_of_the_history(spark):
    rng = random.Random(4)
    names, folders = ["main.py", "model.py", "x.c", "data", "weights", "ab", "notes.md"], ["", "src/", "./", "/app/src/", "lib/", "../src/", "old/lib/"]
    rows, want = [], {}
    for s in range(12):
        history = []
        for t in range(14):
            path = rng.choice(folders) + rng.choice(names)
            if rng.random() < 0.5:
                text = " ".join(rng.choice(["see {}", "{}:3:", "({})", "my{}", "{}x", "{}\n"]).format(path) for _ in range(2))
                rows.append((f"s{s}", t, "ls", text, 0))
            else:
                text = f"cat: {path}: No such file or directory"
                rows.append((f"s{s}", t, f"cat {path}", text, 1))
                want[f"s{s}", t] = "wrong path" if shown_before(path, history) else "missing path"
            history.append(text)
    got = classes(spark, rows)
    assert {k: got[k][0] for k in want} == want and len(set(want.values())) == 2
