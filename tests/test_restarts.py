"""Feeds that go on after a restart: without new data, after a failed batch, after many batches."""

import pytest

from tallyforge.streaming import feeds

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)

    def add(rows):
        spark.createDataFrame(rows, "k long, at long, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        return spark.readStream.schema("k long, at long, v string").parquet(f"{tmp_path}/in")

    return add, str(tmp_path)


KINDS = {
    "latest": lambda s, f, p: feeds.latest_view(s, f, f"{p}/out", "k", "at", f"{p}/ck", shards=4),
    "first": lambda s, f, p: feeds.first_per_request(s, f, f"{p}/out", ["k"], "at", f"{p}/ck"),
    "frames": lambda s, f, p: feeds.bounded_frames(s, f, f"{p}/out", "k", "at", 1, f"{p}/ck").drop("frames"),
}


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_calls_without_new_data(spark, stream, kind):
    add, path = stream
    feed = add([(1, 1, "a"), (2, 2, "b"), (1, 3, "c")])
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    first = rows(KINDS[kind](spark, feed, path))
    assert first == {"latest": [(1, 3, "c"), (2, 2, "b")], "first": [(1, 1, "a"), (2, 2, "b")], "frames": [(1, 3, "c"), (2, 2, "b")]}[kind]
    for _ in range(2):
        assert rows(KINDS[kind](spark, feed, path)) == first
    again = rows(KINDS[kind](spark, add([(2, 9, "d"), (3, 8, "e")]), path))
    assert again == {"latest": [(1, 3, "c"), (2, 9, "d"), (3, 8, "e")], "first": [(1, 1, "a"), (2, 2, "b"), (3, 8, "e")], "frames": [(1, 3, "c"), (2, 2, "b"), (2, 9, "d"), (3, 8, "e")]}[kind]


def test_what_a_failed_batch_left_is_not_read(spark, stream):
    add, path = stream
    feed = add([(1, 1, "a")])
    feeds.latest_view(spark, feed, f"{path}/out", "k", "at", f"{path}/ck", shards=4)
    broken = spark.createDataFrame([(0, 7)], "shard int, held_by long")
    broken.write.parquet(f"{path}/out/index/v1")
    from pathlib import Path

    Path(f"{path}/out/index/v1/_SUCCESS").unlink()
    assert feeds.written_batches(spark, f"{path}/out/index") == [0]
    got = feeds.latest_view(spark, add([(1, 5, "b")]), f"{path}/out", "k", "at", f"{path}/ck", shards=4)
    assert [tuple(r) for r in got.collect()] == [(1, 5, "b")]


def test_an_index_is_all_that_is_read(spark, stream):
    """Twenty batches: the last index names every shard, whatever batch wrote it."""
    add, path = stream
    for i in range(20):
        got = feeds.latest_view(spark, add([(i % 7, i, str(i))]), f"{path}/out", "k", "at", f"{path}/ck", shards=4)
    assert sorted(tuple(r) for r in got.collect()) == sorted((k, max(i for i in range(20) if i % 7 == k), str(max(i for i in range(20) if i % 7 == k))) for k in range(7))
    last = spark.read.parquet(f"{path}/out/index/v19")
    assert last.count() <= 4 and last.where("held_by > 19").count() == 0


def test_nothing_at_all(spark, stream):
    add, path = stream
    feed = add([])
    for kind, f in KINDS.items():
        assert f(spark, feed, f"{path}/{kind}").count() == 0
