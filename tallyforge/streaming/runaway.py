"""Cutting a generated text that has run away, while it streams.

The cut is the shortest prefix, from `least` characters on, of which the last `tail`
characters are one piece repeated (periods from `low` to `high`), or of which one of the
last `window` complete lines, stripped and `shortest` characters long at least, occurs
`repeats` times. It depends on the text alone, however it is split into chunks: a chunk is
looked at together with the tail before it, and lines are kept as digests.

What is kept per text has a fixed size: the last characters, digests of the last lines, and
two running digests of the line that is not complete yet, whatever its length.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PRIME = (1 << 127) - 1


@dataclass(frozen=True)
class Limits:
    least: int = 20_000
    tail: int = 400
    low: int = 20
    high: int = 80
    window: int = 60
    repeats: int = 8
    shortest: int = 20


@dataclass
class Scan:
    """What is known of a text so far. Digests are whole numbers modulo a prime, hexadecimal in JSON."""

    seen: int = 0
    end: str = ""
    #: Of the complete lines: digest, or "" for a short one.
    lines: list[str] = field(default_factory=list)
    #: Of the line in the making, from its first character that is no blank: digest and length of all of it, and up to its last character that is no blank.
    whole: int = 0
    whole_n: int = 0
    bare: int = 0
    bare_n: int = 0

    def to_json(self) -> str:
        return json.dumps(asdict(self) | {"whole": f"{self.whole:x}", "bare": f"{self.bare:x}"})

    @staticmethod
    def of(text: str) -> Scan:
        d = json.loads(text)
        return Scan(**(d | {"whole": int(d["whole"], 16), "bare": int(d["bare"], 16)}))

    def _grow(self, piece: str) -> None:
        """Add characters to the line in the making."""
        if not self.whole_n:
            piece = piece.lstrip()
        kept = piece.rstrip()
        for part, last in ((kept, True), (piece[len(kept) :], False)):
            if part:
                raw = part.encode("utf-8", "surrogatepass")
                self.whole = (self.whole * pow(256, len(raw), _PRIME) + int.from_bytes(raw)) % _PRIME
                self.whole_n += len(part)
                if last:
                    self.bare, self.bare_n = self.whole, self.whole_n

    def _line(self, limits: Limits) -> None:
        """The line in the making is complete."""
        self.lines = [*self.lines, f"{self.bare:x}:{self.bare_n}" if self.bare_n >= limits.shortest else ""][-limits.window :]
        self.whole = self.whole_n = self.bare = self.bare_n = 0

    def _recurring(self, limits: Limits) -> int:
        counts = Counter(x for x in self.lines if x)
        most = max(counts.values(), default=0)
        return most if most >= limits.repeats else 0

    def add(self, chunk: str, limits: Limits) -> tuple | None:
        """Take in a chunk; (rule, at, piece, times) when the text is to be cut in it."""
        periodic = self._periodic(chunk, limits)
        start, cut = self.seen, None
        at = 0
        while at <= len(chunk):
            stop = chunk.find("\n", at)
            upto = len(chunk) if stop < 0 else stop + 1
            # before the next line end nothing changes but the length: the rule may hold from `least` on
            n = max(limits.least, start + at, 1)
            if n <= start + (upto if stop < 0 else stop) and (times := self._recurring(limits)) and n > start:
                cut = ("repeated line", n, "", times)
                break
            self._grow(chunk[at:upto])
            if stop < 0:
                break
            self._line(limits)
            if start + upto >= limits.least and (times := self._recurring(limits)):
                cut = ("repeated line", start + upto, "", times)
                break
            at = upto
        self.seen += len(chunk)
        self.end = (self.end + chunk)[-(limits.tail - 1) :]
        if periodic and (cut is None or periodic[1] <= cut[1]):
            return periodic
        return cut

    def _periodic(self, chunk: str, limits: Limits) -> tuple | None:
        text = self.end + chunk
        offset = self.seen - len(self.end)
        first = max(limits.least, limits.tail, self.seen + 1) - offset  # the shortest prefix of text that is to be looked at
        if first > len(text):
            return None
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        best = None
        for p in _periods(codes, limits):
            wrong = np.flatnonzero(codes[p:] != codes[:-p]) + p  # places that differ from the place p before
            # a prefix of n characters has the period when no place from n - tail + p on is wrong
            n = first
            while n <= (best[0] if best else len(text)):
                i = np.searchsorted(wrong, n, "left") - 1
                bad = int(wrong[i]) if i >= 0 else -1
                if bad < n - limits.tail + p:
                    if best is None or n < best[0]:
                        best = (n, p)
                    break
                n = bad + limits.tail - p + 1
        if best is None:
            return None
        n, p = best
        return ("repeated piece", n + offset, text[n - p : n], limits.tail // p)


def _periods(codes: np.ndarray, limits: Limits) -> list[int]:
    """The periods that a tail of a prefix may have. All of its tail - p characters from the
    p-th on are equal to those p before, so enough of the samples among them are."""
    periods = np.arange(limits.low, limits.high + 1)
    step = (limits.tail - limits.high) // 4
    if step < 2:
        return periods.tolist()
    at = np.arange(0, len(codes), step)[:, None]
    equal = (at >= periods) & (codes[at] == codes[np.maximum(at - periods, 0)])
    return periods[equal.sum(0) >= (limits.tail - periods) // step].tolist()


def find(text: str, limits: Limits = Limits()) -> tuple | None:
    """The cut of a whole text."""
    return Scan().add(text, limits)


RUNAWAY = "key string, rule string, at long, piece string, times int"


class Runaways(StatefulProcessor):
    """Per key a Scan; emits one row when its text is to be cut, and nothing after it."""

    def __init__(self, limits: Limits, forget_ms: int | None):
        self.limits, self.forget_ms = limits, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scan = handle.getValueState("scan", "scan string", self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        known = self.scan.get()[0] if self.scan.exists() else None
        if known == "":  # cut before
            return
        scan, cut = Scan.of(known) if known else Scan(), None
        chunks = pd.concat(list(rows)).sort_values("seq")["chunk"]
        if text := "".join(c for c in chunks if c):  # how it is split does not matter
            cut = scan.add(text, self.limits)
        self.scan.update(("" if cut else scan.to_json(),))
        if cut:
            yield pd.DataFrame([(str(key[0]), *cut)], columns=["key", "rule", "at", "piece", "times"])

    def close(self) -> None:
        pass


def runaways(feed: DataFrame, limits: Limits = Limits(), forget: int | None = None) -> DataFrame:
    """Cuts of a feed (key, seq, chunk) whose chunks arrive in order of seq: key, rule, at
    (characters to keep), piece, times. With `forget`, a text that gets no chunk for so many
    seconds is forgotten; such a query runs on processing time, so it needs a trigger that
    goes on (one that ends with the data present would wait for state to expire). Null and
    empty chunks change nothing. Needs the RocksDB state store provider."""
    mode = "none" if forget is None else "ProcessingTime"
    return feed.groupBy("key").transformWithStateInPandas(Runaways(limits, None if forget is None else forget * 1000), RUNAWAY, "append", mode)
