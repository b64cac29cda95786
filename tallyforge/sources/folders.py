"""Folders as tables: file listings, a file per key written from rows, and files of TOML records.

Listings and writers go through pyarrow's file systems where these reach the path, since
Spark's own commit moves file by file in the driver and its scans give each small file the
cost of 4 MB; other stores are left to Spark.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import logscan

FILES = "path string, bytes long, modified timestamp"


def _system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", folder))


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name


def _entries(folder: str, below: str, glob: str, deep: bool) -> Iterator[tuple]:
    """(path, bytes, modified) of the files right below a path, or all below it when deep;
    if not deep, bytes is null for a folder."""
    from pyarrow import fs

    system, root = _system(folder)
    before = folder[: len(folder) - len(root.rstrip("/"))] if "://" in folder and not folder.startswith("file:") else "file:"
    todo = [below]
    while todo:
        for info in system.get_file_info(fs.FileSelector(todo.pop())):
            if _hidden(info.base_name):
                continue
            if info.type == fs.FileType.Directory:
                if deep:
                    todo.append(info.path)
                else:
                    yield info.path, None, None
            elif fnmatch.fnmatchcase(info.base_name, glob):
                yield before + info.path, info.size, info.mtime


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, bytes, modified) of every file below a folder; contents are not read.

    The driver lists the folder itself, tasks list the folders in it, and after a shuffle
    tasks list those below these, however deep."""
    folder = folder.rstrip("/")
    if not logscan.reachable(folder) or re.search(r"[\\{\[]", glob):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
        return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))

    def step(deep: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path in b.column(0).to_pylist():
                    rows, kinds = [], [pa.string(), pa.int64(), pa.timestamp("us", "UTC")]
                    for row in _entries(folder, path, glob, deep):
                        rows.append(row)
                        if len(rows) == 10_000:
                            yield _batch(rows, kinds)
                            rows = []
                    if rows:
                        yield _batch(rows, kinds)

        return run

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    top = spark.createDataFrame(list(_entries(folder, _system(folder)[1], glob, False)), FILES)
    folders = top.where("bytes is null").select("path")
    second = folders.repartition(width, "path").mapInArrow(step(False), FILES)
    rest = second.where("bytes is null").select("path").repartition(width, "path").mapInArrow(step(True), FILES)
    return top.where("bytes is not null").unionByName(second.where("bytes is not null")).unionByName(rest)


def _batch(rows: list[tuple], kinds: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["path", "bytes", "modified"])


def write_lines(df: DataFrame, folder: str, by: list[str], value: str = "value", end: str = "\n") -> None:
    """A text file per value of the columns `by`, at by=value/.../part.txt below a new
    folder: the rows' values in no order, each with `end` behind it.

    A file is written by one task in one go, which holds an Arrow batch at most. It appears
    under its name when it is complete, so a task that runs again replaces it.
    """
    rows = df.select(*[F.col(c).cast("string").alias(c) for c in by], F.col(value).cast("string").alias("value"))
    if not logscan.reachable(folder):
        rows.repartition(*by).write.option("lineSep", end or " ").partitionBy(*by).text(folder)
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = _system(folder)
        renames = isinstance(system, fs.LocalFileSystem)
        key = file = at = final = None
        n = 0

        def close() -> None:
            if file is not None:
                file.close()
                if renames:
                    system.move(at, final)

        for b in batches:
            if not len(b):
                continue
            text = pc.binary_join_element_wise(b.column(len(by)).cast(pa.large_string()), pa.scalar(end, pa.large_string()), pa.scalar("", pa.large_string()), null_handling="replace")
            text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
            offsets, data = pa.Array.from_buffers(pa.int64(), len(text) + 1, [None, text.buffers()[1]]), text.buffers()[2]
            parts = [b.column(i) for i in range(len(by))]
            same = None
            for c in parts:
                x, y = c.slice(1), c.slice(0, len(c) - 1)
                eq = pc.fill_null(pc.or_kleene(pc.equal(x, y), pc.and_(pc.is_null(x), pc.is_null(y))), False)
                same = eq if same is None else pc.and_(same, eq)
            starts = [0, *(i + 1 for i, s in enumerate(same.to_numpy(zero_copy_only=False)) if not s)]
            for i, j in zip(starts, [*starts[1:], len(b)], strict=True):
                here = tuple(c[i].as_py() for c in parts)
                if here != key:
                    close()
                    key, n = here, n + 1
                    below = "/".join(f"{c}={'__HIVE_DEFAULT_PARTITION__' if v is None else quote(v, safe='')}" for c, v in zip(by, here, strict=True))
                    system.create_dir(f"{root}/{below}", recursive=True)
                    final = f"{root}/{below}/part.txt"
                    at = f"{root}/{below}/.part-{uuid.uuid4().hex}" if renames else final
                    file = system.open_output_stream(at)
                lo, hi = offsets[i].as_py(), offsets[j].as_py()
                if hi > lo:
                    file.write(data.slice(lo, hi - lo))
        close()
        yield pa.record_batch([pa.array([n], pa.int64())], names=["files"])

    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    system, root = _system(folder)
    system.create_dir(root, recursive=True)
    rows.repartition(width, *by).sortWithinPartitions(*by).mapInArrow(run, "files long").write.format("noop").mode("overwrite").save()


def toml_records(spark: SparkSession, folder: str, fields: dict[str, tuple[str, ...]], schema: str, glob: str = "*") -> DataFrame:
    """A row per TOML file: its path and the named values (key path -> column); missing keys
    are null, and a file that does not parse raises with its path."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder, wholetext=True)

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tomllib

        for f in frames:
            out = []
            for path, text in zip(f["path"], f["value"], strict=True):
                try:
                    record = tomllib.loads(text)
                except tomllib.TOMLDecodeError as e:
                    raise ValueError(f"{path}: {e}") from e
                row = {"path": path}
                for name, keys in fields.items():
                    v = record
                    for k in keys:
                        v = v.get(k) if isinstance(v, dict) else None
                    row[name] = v
                out.append(row)
            yield pd.DataFrame(out, columns=["path", *fields])

    return raw.select(F.col("_metadata.file_path").alias("path"), "value").mapInPandas(parsed, f"path string, {schema}")
