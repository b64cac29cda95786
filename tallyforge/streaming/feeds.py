"""Change feeds: incremental versions of the sequence checks and views."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType


def change_feed(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Commits appended to a folder of JSON lines, in file order."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def deduplicated(feed: DataFrame, request: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each request id; state is kept for `delay` of event time."""
    return feed.withWatermark(time, delay).dropDuplicatesWithinWatermark(request)


def windowed(feed: DataFrame, time: str, width: str, delay: str, by: list[str]) -> DataFrame:
    """Counts per tumbling window and key; windows close when the watermark passes."""
    return feed.withWatermark(time, delay).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


def starts_in_last_hour(rows: DataFrame, time: str) -> DataFrame:
    """rows with `in_hour`: how many started in the hour up to each (batch form of a
    rate limit; rows without a time count each other). Each row also enters the next
    hour's bucket, at the moment it falls out of the hour, so no task sees more than two
    hours of rows, and one running sum over them in order of time gives every count: what
    the hour before holds, plus one for a start, less one for a row that falls out."""
    sec = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    hour = F.floor(sec / 3600)
    own = F.struct(hour.alias("b"), sec.alias("at"), F.lit(0).alias("out"), F.struct(*rows.columns).alias("row"))
    # starts at one moment count for each other, and a row leaves after the starts an hour later
    gone = F.struct((hour + 1).alias("b"), (sec + 3600).alias("at"), F.lit(1).alias("out"), F.lit(None).alias("row"))
    both = rows.select(F.explode(F.when(sec.isNull(), F.array(own)).otherwise(F.array(own, gone))).alias("e")).select("e.*")
    w = Window.partitionBy("b").orderBy("at", "out")
    before = F.sum("out").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    running = F.sum(1 - 2 * F.col("out")).over(w)
    counted = both.select("row", "out", (before + running).alias("in_hour"))
    return counted.where("out = 0").select("row.*", "in_hour")


class LoopGuard(StatefulProcessor):
    """Per key the last six actions since the last changing one; emits repeats."""

    LOOK_BACK = 6

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getListState("past", "action string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        past = [r[0] for r in self.past.get()]
        out = []
        for row in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            if row.changes:
                past = []
                continue
            back = past[::-1]
            if row.action in back:
                out.append((key[0], row.seq, back.index(row.action) + 1))
            past = [*past, row.action][-self.LOOK_BACK :]
        if past:
            self.past.put([(a,) for a in past])
        else:
            self.past.clear()
        yield pd.DataFrame(out, columns=["session", "seq", "distance"])

    def close(self) -> None:
        pass


def loop_guard(feed: DataFrame) -> DataFrame:
    """Repeats in a feed (session, seq, action, changes): session, seq, distance. Needs
    the RocksDB state store provider."""
    return feed.groupBy("session").transformWithStateInPandas(LoopGuard(), "session string, seq long, distance long", "append", "none")


def each_batch(feed: DataFrame, fold, checkpoint: str, mode: str = "append"):
    """fold(batch, number) over what the feed holds now; returns the finished query."""
    q = feed.writeStream.outputMode(mode).foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def written_batches(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the batches whose folder `path`/v<number> is complete, in order. A
    restart without new data finds them as they are; what a failed batch left is not listed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    folders = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("v")]
    done = [p.getName()[1:] for p in folders if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n) for n in done if n.isdigit())


def _batches(spark: SparkSession, path: str, schema) -> DataFrame:
    done = written_batches(spark, path)
    return spark.read.schema(schema).parquet(*[f"{path}/v{i}" for i in done]) if done else spark.createDataFrame([], schema)


def latest_view(spark: SparkSession, feed: DataFrame, path: str, key: str, order: str, checkpoint: str, shards: int = 64) -> DataFrame:
    """The newest row per key, maintained below `path` batch by batch.

    Keys are dealt over `shards` by hash. A batch folds only the shards that it touches:
    they are written anew under the batch's number, and the others stay where they were.
    Its index, written last, names the batch that holds each shard, so a batch or a restart
    reads one index, however many came before. A batch that runs again after a failure
    writes the same rows from the same state.
    """
    shard = F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")
    schema = feed.schema

    def current(before: int | None = None) -> dict[int, int]:
        done = [n for n in written_batches(spark, f"{path}/index") if before is None or n < before]
        if not done:
            return {}
        return {r["shard"]: r["held_by"] for r in spark.read.schema("shard int, held_by long").parquet(f"{path}/index/v{done[-1]}").collect()}  # at most `shards` rows

    def read(where: dict[int, int]) -> DataFrame:
        folders = [f"{path}/rows/v{n}/shard={s}" for s, n in where.items()]  # at most `shards`
        return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)

    def fold(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("shard", shard)
        touched = [r[0] for r in new.select("shard").distinct().collect()]  # at most `shards` rows
        held = current(number)
        rows = new.drop("shard").unionByName(read({s: n for s, n in held.items() if s in touched}))
        best = rows.groupBy(key).agg(F.max_by(F.struct(*schema.names), order).alias("r")).select("r.*").withColumn("shard", shard)
        best.write.mode("overwrite").partitionBy("shard").parquet(f"{path}/rows/v{number}")
        held |= dict.fromkeys(touched, number)
        spark.createDataFrame(list(held.items()), "shard int, held_by long").coalesce(1).write.mode("overwrite").parquet(f"{path}/index/v{number}")

    each_batch(feed, fold, checkpoint)
    return read(current())


class FirstOnly(StatefulProcessor):
    """Per key one flag; emits the first row (smallest `order`) of a key that has none yet."""

    def __init__(self, order: str, names: list[str]):
        self.order, self.names = order, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        best = None
        for frame in rows:
            one = frame.nsmallest(1, self.order)
            best = one if best is None or one[self.order].iloc[0] < best[self.order].iloc[0] else best
        if self.seen.exists():
            return
        self.seen.update((True,))
        yield best[self.names]

    def close(self) -> None:
        pass


def first_per_request(spark: SparkSession, feed: DataFrame, path: str, request: list[str], order: str, checkpoint: str) -> DataFrame:
    """The first row of each request id (smallest `order` of its batch), whatever the age of
    a repeat: a flag per request is kept as keyed state, so a batch reads nothing of those
    before it. Needs the RocksDB state store provider."""
    once = feed.groupBy(*request).transformWithStateInPandas(FirstOnly(order, feed.columns), feed.schema, "append", "none")
    each_batch(once, lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/v{number}"), checkpoint)
    return _batches(spark, path, feed.schema)


def bounded_frames(spark: SparkSession, feed: DataFrame, path: str, key: str, order: str, pending: int, checkpoint: str) -> DataFrame:
    """Frames for a slow watcher: a key with more than `pending` frames in a batch gets one
    full replacement (its newest row) instead of them. Adds `frames`, how many it stands for."""
    names = feed.schema.names

    def fold(batch: DataFrame, number: int) -> None:
        n = F.count("*").over(Window.partitionBy(key))
        newest = F.max(order).over(Window.partitionBy(key))
        rows = batch.withColumn("_n", n).withColumn("_last", newest).where((F.col("_n") <= pending) | (F.col(order) == F.col("_last")))
        rows.select(*names, F.when(F.col("_n") > pending, F.col("_n")).otherwise(F.lit(1).cast("long")).alias("frames")).write.mode("overwrite").parquet(f"{path}/v{number}")

    each_batch(feed, fold, checkpoint)
    return _batches(spark, path, StructType([*feed.schema.fields, StructField("frames", LongType())]))


class HeadAndTail(StatefulProcessor):
    """Per key the first and the last rows of a stream of outputs under limits; emits the
    buffer after each batch of the key: what is kept, and how many rows are left out."""

    HEAD, TAIL = 3, 3

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getListState("head", "seq long")
        self.tail = handle.getListState("tail", "seq long")
        self.seen = handle.getValueState("seen", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        head, tail = [r[0] for r in self.head.get()], [r[0] for r in self.tail.get()]
        n = self.seen.get()[0] if self.seen.exists() else 0
        for seq in sorted(int(s) for f in rows for s in f["seq"]):
            n += 1
            if len(head) < self.HEAD:
                head.append(seq)
            else:
                tail = [*tail, seq][-self.TAIL :]
        self.head.put([(s,) for s in head])
        if tail:
            self.tail.put([(s,) for s in tail])
        self.seen.update((n,))
        yield pd.DataFrame([(key[0], n, ",".join(map(str, head)), ",".join(map(str, tail)), n - len(head) - len(tail))], columns=["session", "n", "head", "tail", "left_out"])

    def close(self) -> None:
        pass


def head_and_tail(feed: DataFrame) -> DataFrame:
    """Buffers of a feed (session, seq) whose rows arrive in order; needs the RocksDB state
    store provider."""
    return feed.groupBy("session").transformWithStateInPandas(HeadAndTail(), "session string, n long, head string, tail string, left_out long", "update", "none")
