"""Throttled commits: bursts, gaps, an end inside the interval, in any batches."""

import datetime

import pytest

from tallyforge.streaming.throttled import throttled

ROWS = [
    # a burst, a gap, a burst with an end inside the interval
    *[("a", i, 10 * i, f"a{i}", False) for i in range(25)], ("a", 30, 900, "late", False), ("a", 31, 910, "later", False), ("a", 32, 950, "done", True),
    ("b", 0, 5, "only", True), ("c", 0, 0, "x", False), ("c", 1, 99, "y", False), ("c", 2, 100, "z", False), ("c", 3, 450, "w", False),
]
#: What waits in the end comes out when time goes on, here by the rows of key t.
TICK = [("t", 0, 5_000, "tick", True), ("t", 1, 9_000, "tick", True)]


def plain(rows, interval=100):
    out, state = [], {}
    for key, _, at, value, final in sorted(rows, key=lambda r: (r[2], r[1])):
        last, waits = state.get(key, (None, None))
        if waits is not None and last + interval <= at:
            last, waits = last + interval, out.append((key, last + interval, waits, False))
        if final:
            out.append((key, at, value, True))
            last = waits = None
        elif last is None or at >= last + interval:
            out.append((key, at, value, False))
            last = at
        else:
            waits = value
        state[key] = (last, waits)
    out += [(k, last + interval, waits, False) for k, (last, waits) in state.items() if waits is not None]
    return sorted(out)


@pytest.mark.parametrize("cuts", [[], [150], [5, 95, 205, 905]])
def test_commits(spark, tmp_path, cuts):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "key string, seq long, at timestamp, value string, final boolean"
    zero = datetime.datetime.fromtimestamp(1_000, datetime.UTC)  # rows at the watermark's start, the epoch, would count as late
    batches = [[r for r in ROWS if low <= r[2] < high] for low, high in zip([0, *cuts], [*cuts, 1_000], strict=True)] + [[t] for t in TICK]
    for b in batches:
        spark.createDataFrame([(k, s, zero + datetime.timedelta(milliseconds=at), v, f) for k, s, at, v, f in b], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        feed = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        throttled(feed).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(60)
    got = sorted((r["key"], r["at_ms"] - 1_000_000, r["value"], r["final"]) for r in spark.read.parquet(f"{tmp_path}/out").where("key <> 't'").collect())
    assert got == plain(ROWS)
    for key in "abc":
        times = [at for k, at, _, final in got if k == key and not final]
        assert all(y - x >= 100 for x, y in zip(times, times[1:], strict=False))
    assert [r for r in got if r[3]] == [("a", 950, "done", True), ("b", 5, "only", True)]
