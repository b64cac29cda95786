"""Partial output committed at most once an interval per key, and its final state always."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COMMITS = "key string, at_ms long, value string, final boolean"


class Throttle(StatefulProcessor):
    """Per key when it was last committed and the newest value that was not.

    A value that comes an interval or more after the last commit is committed as it comes;
    others wait until the interval is over, when only the newest is committed. A final row
    is committed at once and ends the key's state, with whatever waited before it. What is due
    when a later row comes is committed first, so the commits do not depend on how rows fall
    into batches; a timer commits what waits when nothing more comes.
    """

    def __init__(self, interval_ms: int):
        self.interval = interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "committed long, waiting_at long, value string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        committed, waiting, value = self.state.get() if self.state.exists() else (None, None, None)
        had, out = waiting is not None, []
        frame = pd.concat(list(rows)).sort_values(["at", "seq"])
        for row in frame.itertuples(index=False):
            at = row.at.value // 1_000_000
            if waiting is not None and committed + self.interval <= at:  # it was due before this row
                committed, waiting = committed + self.interval, None
                out.append((key[0], committed, value, False))
            if row.final:
                out.append((key[0], at, row.value, True))
                committed = waiting = value = None
            elif committed is None or at >= committed + self.interval:
                out.append((key[0], at, row.value, False))
                committed, value = at, row.value
            else:
                waiting, value = at, row.value
        if had:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        if committed is None:
            self.state.clear()
        else:
            self.state.update((committed, waiting, value))
            if waiting is not None:
                self.handle.registerTimer(committed + self.interval)
        if out:
            yield pd.DataFrame(out, columns=["key", "at_ms", "value", "final"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        committed, waiting, value = self.state.get() if self.state.exists() else (None, None, None)
        if waiting is not None:  # else what waited went with a later row
            self.state.update((committed + self.interval, None, value))
            yield pd.DataFrame([(key[0], committed + self.interval, value, False)], columns=["key", "at_ms", "value", "final"])

    def close(self) -> None:
        pass


def throttled(feed: DataFrame, interval_ms: int = 100, delay: str = "0 seconds") -> DataFrame:
    """Commits of a feed (key, seq, at timestamp, value, final): key, at_ms, value, final.
    Rows of a key come in the order of (at, seq) up to `delay`, the watermark's. Needs the
    RocksDB state store provider."""
    marked = feed.withWatermark("at", delay)
    return marked.groupBy("key").transformWithStateInPandas(Throttle(interval_ms), COMMITS, "append", "EventTime")
