"""Edits of texts by what they replace, found also where quotes, dashes and blanks differ."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types

#: Characters that count as a plain one.
_PLAIN = {"'": "‘’‚‛", '"': "“”„‟", "-": "‐‑‒–—―−", " ": "            　"}
_SAME = {ord(c): plain for plain, many in _PLAIN.items() for c in many}


def alike(text: str) -> str:
    """The text in which edits are looked for: compatible forms, plain quotes, dashes and
    blanks, no blanks at the ends of lines. It has the lines of the text, one for one."""
    return "\n".join(unicodedata.normalize("NFKC", line).rstrip().translate(_SAME) for line in text.split("\n"))


def _line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at)


def edited(content: str, edits: list[tuple[str, str]]) -> tuple[str | None, str | None, list[int]]:
    """(new content, problem, first lines from 1 of the places) after replacing each old text by its new one.

    Every old text must stand in the content once, as it is or alike; all are looked for in
    the same content and must not overlap. If one is only alike, lines that an edit touches
    are written in their plain form; all other lines stay as they are, to the byte. Problems:
    empty, not found, several, overlap, no change.
    """
    plain, exact = alike(content), all(old in content for old, _ in edits)
    base, found = content if exact else plain, []
    for old, new in edits:
        if not old:
            return None, "empty", []
        wanted = old if old in base else alike(old)
        at = base.find(wanted)
        if at < 0 or not wanted:
            return None, "not found", []
        if plain.count(alike(old)) > 1:
            return None, "several", []
        found.append((at, at + len(wanted), new))
    found.sort()
    if any(a[1] > b[0] for a, b in zip(found, found[1:], strict=False)):
        return None, "overlap", []
    lines = [_line_of(base, at) + 1 for at, _, _ in found]
    if exact:
        out, last = [], 0
        for at, end, new in found:
            out += [content[last:at], new]
            last = end
        made = "".join([*out, content[last:]])
    else:
        made = _overlaid(content, plain, found)
    return (None, "no change", lines) if made == content else (made, None, lines)


def _overlaid(content: str, plain: str, found: list[tuple[int, int, str]]) -> str:
    """The content with touched lines in their plain form and the found places replaced."""
    given, out, done = content.split("\n"), [], 0
    starts = [0]
    for line in plain.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    i = 0
    while i < len(found):
        first, last, j = _line_of(plain, found[i][0]), _line_of(plain, max(found[i][0], found[i][1] - 1)), i + 1
        while j < len(found) and _line_of(plain, found[j][0]) <= last:
            last, j = max(last, _line_of(plain, max(found[j][0], found[j][1] - 1))), j + 1
        text, at = [], starts[first]
        for start, end, new in found[i:j]:
            text += [plain[at:start], new]
            at = end
        # a place that ends in a line end takes the next line's start with it
        upto = max(starts[last + 1] - 1, at)
        out += given[done:first] + ["".join([*text, plain[at:upto]])]
        done, joined = last + 1, at > starts[last + 1] - 1
        if joined and done < len(given):
            out[-1] += given[done]
            done += 1
        i = j
    return "\n".join(out + given[done:])


RESULT = types.StructType([types.StructField("content", types.StringType()), types.StructField("problem", types.StringType()), types.StructField("lines", types.ArrayType(types.IntegerType()))])


@F.arrow_udf(RESULT)
def applied_edits(content: pa.Array, edits: pa.Array) -> pa.Array:
    """edited() of a text and an array of structs (old, new), as struct(content, problem, lines); null for a null text."""
    rows = []
    for text, many in zip(content.to_pylist(), edits.to_pylist(), strict=True):
        if text is None:
            rows.append(None)
            continue
        made, problem, lines = edited(text, [(e["old"] or "", e["new"] or "") for e in many or []])
        rows.append({"content": made, "problem": problem, "lines": lines})
    return pa.array(rows, pa.struct([("content", pa.string()), ("problem", pa.string()), ("lines", pa.list_(pa.int32()))]))
