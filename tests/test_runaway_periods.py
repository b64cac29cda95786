"""Periods ruled out by samples; the chunks of a batch looked at in one go."""

import random

import numpy as np
import pandas as pd

from tallyforge.streaming import runaway


def every(codes, limits):
    return list(range(limits.low, limits.high + 1))


def test_samples_rule_out_no_period(monkeypatch):
    rng = random.Random(4)
    cases = []
    for i in range(150):
        limits = rng.choice([runaway.Limits(least=100), runaway.Limits(least=1, tail=90, low=5, high=30), runaway.Limits(least=1, tail=40, low=5, high=38)])
        piece = "".join(rng.choices("abcdefgh é", k=rng.randrange(limits.low - 1, limits.high + 2)))
        run = (piece * 200)[: limits.tail + rng.randrange(-3, 40)]
        cases.append(("".join(rng.choices("abcdefgh é", k=rng.randrange(300))) + run + "".join(rng.choices("xyz", k=rng.randrange(50))), limits))
    fast = [runaway.find(t, limits) for t, limits in cases]
    monkeypatch.setattr(runaway, "_periods", every)
    assert fast == [runaway.find(t, limits) for t, limits in cases] and 50 < sum(x is not None for x in fast) < 150
    monkeypatch.undo()
    codes = np.frombuffer(("".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=900))).encode("utf-32-le"), np.uint32)
    assert len(runaway._periods(codes, runaway.Limits())) < 10  # of 61


class Value:
    def __init__(self):
        self.now = None

    def exists(self):
        return self.now is not None

    def get(self):
        return self.now

    def update(self, row):
        self.now = row


def test_a_batch_is_scanned_once(monkeypatch):
    calls, add = [], runaway.Scan.add
    monkeypatch.setattr(runaway.Scan, "add", lambda self, text, limits: calls.append(text) or add(self, text, limits))
    p = runaway.Runaways(runaway.Limits(least=500), None)
    p.scan = Value()
    text = "words of a text that goes on " * 3 + "0123456789abcdefghijklmnopqrst" * 40
    rows = [(i, text[i * 100 : i * 100 + 100] or None) for i in range(14)]
    frame = pd.DataFrame(random.Random(1).sample(rows[:3], 3), columns=["seq", "chunk"])
    later = pd.DataFrame(random.Random(1).sample(rows[3:], 11), columns=["seq", "chunk"])
    assert list(p.handleInputRows(("k",), iter([frame]), None)) == []
    (out,) = p.handleInputRows(("k",), iter([later.iloc[:4], later.iloc[4:]]), None)
    assert len(calls) == 2 and tuple(out.iloc[0])[1:] == runaway.find(text, runaway.Limits(least=500))
