"""A source of log lines that opens only the files whose name's time is asked for, and reads
no more of a file than is wanted.

`log_files` lists a folder, cuts its files into byte ranges and gives (path, time, start,
line): time from the file's path (2024-05-01T08-25-07-381Z; null without one), start the
byte at which the line begins. Of the options since (from that time on) and before, a file
that does not pass is never opened, nor is one without a time when either is given. They
are options rather than filters that Spark hands down, since in Spark 4.1 a filter once
handed to a Python source stays with the frame and would hold for its other uses too. With
option only = first, a task reads a file up to its first line end; with only = names it
opens none. Lines are UTF-8; what is not is replaced. Paths are those that pyarrow's file
systems reach (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import contextlib
import datetime
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_STAMP = re.compile(r"(\d{4}-\d{2}-\d{2})T(\d{2})-(\d{2})-(\d{2})-(\d{3})Z")
#: Bytes of a range, of a block that is read at once, and most files of a task (with no more bytes than a range).
RANGE, BLOCK, FILES = 64 << 20, 1 << 16, 200
SCHEMES = ("file", "hdfs", "s3", "s3a", "gs", "gcs", "abfs", "abfss")


def reachable(path: str) -> bool:
    """Whether pyarrow's file systems know the scheme of a path."""
    scheme = re.match(r"([a-zA-Z][\w+.-]*)://?", path)
    return scheme is None or scheme[1] in SCHEMES


def stamp_of(path: str) -> datetime.datetime | None:
    """The time in a path, in UTC; the last one of several."""
    found = _STAMP.findall(path)
    if not found:
        return None
    day, *clock = found[-1]
    try:
        return datetime.datetime.fromisoformat(f"{day}T{':'.join(clock[:3])}.{clock[3]}+00:00")
    except ValueError:
        return None


def _utc(time: str | None) -> datetime.datetime | None:
    at = datetime.datetime.fromisoformat(time) if time else None
    return at.replace(tzinfo=datetime.UTC) if at and at.tzinfo is None else at


@dataclass
class Ranges(InputPartition):
    #: (path, first byte, one past the last byte, time)
    items: list[tuple[str, int, int, datetime.datetime | None]]


class LogReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.suffix, self.only = options["path"], options.get("suffix", ".jsonl"), options.get("only", "all")
        self.range = int(options.get("range", RANGE))
        self.since, self.before = (_utc(options.get(k)) for k in ("since", "before"))
        #: What this object has opened and read, for measurements.
        self.opened, self.bytes_read = [], 0

    def _wanted(self, at: datetime.datetime | None) -> bool:
        if at is None:
            return self.since is None and self.before is None
        return (self.since is None or at >= self.since) and (self.before is None or at < self.before)

    def _system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", self.folder) if self.folder.startswith("file:") else self.folder)

    def partitions(self) -> list[Ranges]:
        from pyarrow import fs

        system, root = self._system()
        ranges = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            below = posixpath.relpath(info.path, root)
            if info.type != fs.FileType.File or not info.base_name.endswith(self.suffix) or any(p.startswith(("_", ".")) for p in below.split("/")):
                continue
            at = stamp_of(below)
            if not self._wanted(at):
                continue
            step = self.range if self.only == "all" else max(info.size, 1)
            ranges += [(info.path, i, min(i + step, info.size), at) for i in range(0, max(info.size, 1), step)]
        packs, held = [[]], 0
        for r in ranges:
            size = r[2] - r[1] if self.only == "all" else 0
            if packs[-1] and (len(packs[-1]) == FILES or held + size > self.range):
                packs.append([])
                held = 0
            packs[-1].append(r)
            held += size
        return [Ranges(p) for p in packs]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        system, _ = self._system()
        for path, start, end, at in partition.items:
            if self.only == "names":
                yield path, at, None, None
                continue
            self.opened.append(path)
            with system.open_input_file(path) as file:
                for place, line in self._lines(file, start, end):
                    yield path, at, place, line.decode("utf-8", "replace")
                    if self.only == "first":
                        break

    def _lines(self, file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
        """(place, line) of the lines that begin in [start, end)."""
        place, held, skip = start, b"", False
        if start:  # a line that began before belongs to the range before
            file.seek(start - 1)
            place, skip = start - 1, True
        done = False
        while not done:
            block = file.read(BLOCK)
            self.bytes_read += len(block)
            done = len(block) < BLOCK and not block
            held += block
            *whole, held = held.split(b"\n")
            for line in whole:
                if not skip:
                    if place >= end:
                        return
                    yield place, line
                skip = False
                place += len(line) + 1
            if place >= end and not skip:
                return
        if held and not skip and place < end:
            yield place, held


class BatchReader(LogReader):
    """The same rows in Arrow batches; a file that a range holds whole is read and split at once."""

    #: Rows and bytes of lines of a batch.
    ROWS, BYTES = 20_000, 8 << 20

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        paths, times, counts, places, lines, size = [], [], [], [], [], 0

        def batch() -> pa.RecordBatch:
            of = pa.array(np.repeat(np.arange(len(paths)), counts))
            try:
                text = pa.array(lines, pa.binary()).cast(pa.string())
            except pa.ArrowInvalid:  # what is not UTF-8 is replaced
                text = pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())
            cols = [pa.array(paths, pa.string()).take(of), pa.array(times, pa.timestamp("us", "UTC")).take(of), pa.array(np.concatenate(places)), text]
            return pa.record_batch(cols, names=["path", "time", "start", "line"])

        system, _ = self._system()
        for path, start, end, at in partition.items:
            self.opened.append(path)
            with system.open_input_stream(path) if start == 0 and end <= self.BYTES else contextlib.nullcontext() as file:
                data = file.read(end + 1) if file else b""
            if file and len(data) == end:
                self.bytes_read += end
                found = data.split(b"\n")
                if not found[-1]:
                    found.pop()
                lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
                rows = [(np.cumsum(lengths) - lengths, found)]
            else:  # a part of a file, or one that has grown since it was listed
                rows = self._some(system, path, start, end)
            for where, found in rows:
                paths.append(path)
                times.append(at)
                counts.append(len(found))
                places.append(where)
                lines += found
                size += sum(map(len, found)) + len(path)
                if len(lines) >= self.ROWS or size >= self.BYTES:
                    yield batch()
                    paths, times, counts, places, lines, size = [], [], [], [], [], 0
        if lines:
            yield batch()

    def _some(self, system, path: str, start: int, end: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        with system.open_input_file(path) as file:
            pairs, size = [], 0
            for pair in self._lines(file, start, end):
                pairs.append(pair)
                size += len(pair[1])
                if len(pairs) >= self.ROWS or size >= self.BYTES:
                    yield np.array([p for p, _ in pairs], np.int64), [x for _, x in pairs]
                    pairs, size = [], 0
            if pairs:
                yield np.array([p for p, _ in pairs], np.int64), [x for _, x in pairs]


class LogFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_files"

    def schema(self) -> str:
        return "path string, time timestamp, start long, line string"

    def reader(self, schema) -> LogReader:
        whole = self.options.get("only", "all") == "all"
        return (BatchReader if whole else LogReader)(self.options)


def scan(spark: SparkSession, folder: str, suffix: str = ".jsonl", only: str = "all", since: str | None = None, before: str | None = None) -> DataFrame:
    """The log_files source below a folder; since and before are ISO times, UTC without a zone."""
    spark.dataSource.register(LogFiles)
    read = spark.read.format("log_files").option("suffix", suffix).option("only", only)
    for name, time in (("since", since), ("before", before)):
        if time is not None:
            read = read.option(name, time)
    return read.load(folder)
