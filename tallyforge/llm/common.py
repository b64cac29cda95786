"""What several operators of this subpackage share: tables in the cluster's
shared folder, connected components, and small helpers.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graphs

#: White space of the word rules: blank, and the controls 9 to 13.
BLANKS = " \t\n\x0b\x0c\r"
#: The same as a Java regular expression class, and its complement as words.
BLANK_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
#: Most rows of an Arrow batch; with long texts a batch stays in the tens of MB.
BATCH_ROWS = 400

#: Tables of written() by owner; None owns those that last as long as the session.
_SCRATCH: dict[str | None, list[str]] = {}
_OWNER: contextvars.ContextVar[str | None] = contextvars.ContextVar("scratch owner", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Only where a local master names none (tests) a temporary one is set; a cluster must
    name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyforge-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def token() -> str:
    return uuid.uuid4().hex


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder; removed at exit, or with its owner's tables."""
    path = f"{shared_dir(spark)}/tallyforge-{what}-{token()}"
    if not _SCRATCH:
        atexit.register(_clear_all)
    _SCRATCH.setdefault(_OWNER.get(), []).append(path)
    return path


@contextlib.contextmanager
def owned(owner: str):
    """Scratch tables that are made inside belong to `owner`."""
    before = _OWNER.set(owner)
    try:
        yield
    finally:
        _OWNER.reset(before)


def written(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts lineage,
    survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear_scratch(spark: SparkSession, owner: str) -> None:
    """Delete the tables of one owner, whose frames must be done. Others' stay."""
    for path in _SCRATCH.pop(owner, []):
        remove(spark, path)


def _clear_all() -> None:
    spark = SparkSession.getActiveSession()
    try:
        for owner in list(_SCRATCH):
            if spark is not None:
                clear_scratch(spark, owner)
    except Exception:  # the session has gone; its folder is the cluster's to clean
        _SCRATCH.clear()


def small_batches(spark: SparkSession) -> None:
    """Bound the rows of an Arrow batch, so that batches of long texts fit in memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string")) % n


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, what: str = "components") -> DataFrame:
    """graphs.components() with its tables among this subpackage's scratch tables."""
    return graphs.components(edges, nodes, lambda df, name: written(df, f"{what}-{name}"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_names(df: DataFrame, names: list[str]) -> list[str]:
    """The names, each with underscores before it until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def appended(docs: DataFrame, text: str, compute, fields: list[tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    """docs with columns computed in Arrow batches from its text column.

    compute(iterator of lists of texts) yields, per list, a list of Arrow arrays, one
    per (name, type) of fields. Returns the DataFrame and the names that the new
    columns got (changed only where docs has such a column).
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    small_batches(docs.sparkSession)
    names = free_names(docs, [n for n, _ in fields])
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, (_, t) in zip(names, fields, strict=True))).fields])
    whole = [*docs.columns, *names]

    def run(batches):
        kept: list = []

        def texts():
            for b in batches:
                kept.append(b)
                yield b.column(at).to_pylist()

        for arrays in compute(texts()):
            b = kept.pop(0)
            yield pa.record_batch([*b.columns, *arrays], names=whole)

    return docs.mapInArrow(run, schema), names


def has_unique_ids(docs: DataFrame) -> bool:
    """Whether doc_id is an integer column without nulls and without repeats."""
    if dict(docs.dtypes)["doc_id"] not in ("bigint", "int"):
        return False
    return docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty()


#: A key with more than this share of the rows is heavy; there are fewer than 1 / HEAVY of them.
HEAVY = 1 / 1000


def heavy_join(left: DataFrame, right: DataFrame, key: str, count: str) -> DataFrame:
    """Inner join of left with right, which has each key once and in `count` how many
    rows of left hold it (dropped here). Keys that hold more than HEAVY of all rows,
    fewer than 1,000 by that, are joined by broadcast, so that their rows stay where they
    are; the others by shuffle. Both frames are read twice: pass written ones."""
    total = right.agg(F.sum(count).alias("n")).first()["n"] or 0
    heavy = F.col(count) > total * HEAVY
    few = right.where(heavy).drop(count)
    rest = left.join(F.broadcast(few.select(key)), key, "left_anti").join(right.where(~heavy).drop(count), key)
    return left.join(F.broadcast(few), key).unionByName(rest)


def monotone() -> Column:
    return F.monotonically_increasing_id()
