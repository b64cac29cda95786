"""Shell commands as data: simple commands with their words, redirections, here-documents and place in a pipe."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types
from pyspark.sql.pandas.types import to_arrow_type

_LIST = types.ArrayType(types.StringType())
#: One simple command. argv has no quotes, redirections, assignments or wrappers before the
#: program (those are in lead); outputs are files it writes by redirection; body is the text
#: of its here-document; open says that a quote never ends.
PART = types.StructType(
    [types.StructField(n, k) for n, k in (("argv", _LIST), ("lead", _LIST), ("pipe", types.IntegerType()), ("stage", types.IntegerType()), ("outputs", _LIST), ("input", types.BooleanType()), ("body", types.StringType()), ("text", types.StringType()), ("open", types.BooleanType()))]
)
_PARTS = pa.list_(to_arrow_type(PART))

#: Programs that run the command behind their own options, and those of their
#: options that take the next word.
WRAPPERS = {"sudo": ("-u", "-g"), "time": ("-f", "-o"), "timeout": ("-k", "-s"), "env": ("-u",), "nice": ("-n",), "ionice": ("-c", "-n"), "stdbuf": (), "nohup": (), "setsid": (), "exec": ()}
_OPENING, _HEADS, _CLOSING = {"then", "do", "else", "elif", "if", "while", "until", "!", "{"}, {"for", "case", "select", "function"}, {"done", "fi", "esac", "}"}
_REDIRECT = re.compile(r"(?:\d*|&)(<<<|<<-?|>>|>\||>&|<&|<>|>|<)")
_OPERATOR = re.compile(r"&&|\|\||;;|\|&|[;&|()]")
_DOUBLE = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)
_ASSIGNED = re.compile(r"[A-Za-z_]\w*\+?=")
_DURATION = re.compile(r"\d+(\.\d+)?[smhd]?")


def _bracket(t: str, i: int) -> int:
    """Where the bracket that opens at i is shut again, one past it; the end if it is not."""
    depth, pair = 0, {"(": ")", "{": "}"}[t[i]]
    opens = t[i]
    while i < len(t):
        c = t[i]
        if c == "\\":
            i += 1
        elif c == "'":
            i = t.find("'", i + 1)
            if i < 0:
                return len(t)
        elif c == opens:
            depth += 1
        elif c == pair:
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return len(t)


def _word(t: str, i: int) -> tuple[str, int, bool]:
    """(word without quotes, one past its end, whether a quote stays open) at i."""
    out = []
    while i < len(t) and t[i] not in " \t\n;|&<>()":
        c = t[i]
        if c == "\\":
            out.append("" if t[i + 1 : i + 2] == "\n" else t[i + 1 : i + 2])
            i += 2
        elif c == "'":
            end = t.find("'", i + 1)
            if end < 0:
                return "".join(out) + t[i + 1 :], len(t), True
            out.append(t[i + 1 : end])
            i = end + 1
        elif c == '"':
            m = _DOUBLE.match(t, i)
            if not m:
                return "".join(out) + t[i + 1 :], len(t), True
            out.append(re.sub(r'\\(["\\$`]|\n)', lambda x: x[1].strip("\n"), m[1]))
            i = m.end()
        elif c == "$" and t[i + 1 : i + 2] in ("(", "{"):
            end = _bracket(t, i + 1)
            out.append(t[i:end])
            i = end
        elif c == "`" and (end := t.find("`", i + 1)) > 0:
            out.append(t[i : end + 1])
            i = end + 1
        else:
            out.append(c)
            i += 1
    return "".join(out), i, False


def _led(words: list[str]) -> int:
    """How many of the first words are assignments and wrappers with their options."""
    i = 0
    while i < len(words):
        w = words[i].rsplit("/", 1)[-1]
        if _ASSIGNED.match(words[i]):
            i += 1
        elif w in WRAPPERS and i + 1 < len(words):
            i += 1
            while i < len(words) and words[i].startswith("-"):
                i += 2 if words[i] in WRAPPERS[w] else 1
            if w == "timeout" and i < len(words) and _DURATION.fullmatch(words[i]):
                i += 1
        else:
            break
    return i


def parts(t: str) -> list[dict]:
    """The simple commands of a shell text, in order (see PART)."""
    made: list[dict] = []
    pipe, stage, i, begin = 0, 0, 0, 0
    words: list[str] = []
    now = {"outputs": [], "input": False, "body": None, "open": False}
    waiting: list[tuple[str, bool, object]] = []

    def close(end: int) -> None:
        nonlocal words, now
        while words and words[0] in _OPENING:
            words.pop(0)
        if words and words[0] not in _HEADS and words[0] not in _CLOSING:
            inner = re.fullmatch(r"\w+=\$\((.*)\)", words[0], re.S) if len(words) == 1 else None
            if inner:
                made.extend(p | {"pipe": pipe, "outputs": p["outputs"] + now["outputs"]} for p in parts(inner[1]))
            else:
                n = _led(words)
                made.append(now | {"argv": words[n:], "lead": words[:n], "pipe": pipe, "stage": stage, "text": t[begin:end].strip()})
        elif not words and now["outputs"]:
            made.append(now | {"argv": [], "lead": [], "pipe": pipe, "stage": stage, "text": t[begin:end].strip()})
        words, now = [], {"outputs": [], "input": False, "body": None, "open": False}

    while i < len(t):
        if t[i] in " \t":
            i += 1
        elif t.startswith("\\\n", i):
            i += 2
        elif t[i] == "#":
            i = t.find("\n", i) if "\n" in t[i:] else len(t)
        elif t[i] == "\n":
            close(i)
            i += 1
            for name, tabs, owner in waiting:
                end = re.compile(rf"^{'[ \t]*' if tabs else ''}{re.escape(name)}[ \t]*$", re.M).search(t, i)
                body = t[i : end.start() if end else len(t)]
                for p in made:
                    if p.get("here") is owner:
                        p["body"] = body
                i = min(len(t), end.end() + 1) if end else len(t)
            waiting.clear()
            pipe, stage, begin = pipe + 1, 0, i
        elif m := _REDIRECT.match(t, i):
            i = m.end()
            while i < len(t) and t[i] in " \t":
                i += 1
            target, i, _ = _word(t, i)
            if m[1] in ("<<", "<<-"):
                now["here"] = owner = object()
                waiting.append((target, m[1] == "<<-", owner))
                now["body"] = ""
            elif m[1].startswith("<"):
                now["input"] = True
            elif target and not target.startswith("/dev/") and not (m[1] == ">&" and re.fullmatch(r"\d+|-", target)):
                now["outputs"].append(target)
        elif m := _OPERATOR.match(t, i):
            close(i)
            i = m.end()
            pipe, stage = (pipe, stage + 1) if m[0] in ("|", "|&") else (pipe + 1, 0)
            begin = i
        else:
            w, i, open_ = _word(t, i)
            words.append(w)
            now["open"] |= open_
    close(len(t))
    return [{k: v for k, v in p.items() if k != "here"} for p in made]


@F.arrow_udf(types.ArrayType(PART))
def parsed(command: pa.Array) -> pa.Array:
    """The parts of each command; null for null."""
    return pa.array([None if t is None else parts(t) for t in command.to_pylist()], _PARTS)
