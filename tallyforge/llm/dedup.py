"""Exact deduplication with Patricia tries that own each text.

Texts are equal when their bytes are equal once the blanks `[\\x20\\x09-\\x0D]` are
deleted. Every input task first inserts its own texts into a trie (so a text that a
third of all rows carry leaves each task once, with a count), then the distinct ones
are dealt out by length and content hash, and the owner of each full byte string is
settled in the trie of that partition. A terminal node stores the owner: most code
points in the original text, then the smallest doc_id, then the smallest row number,
and the number of rows. A task's trie holds at most TRIE_BYTES; beyond that its largest
subtrees are emptied: their terminals leave as partial owners from the first trie, and
as settled ones from the second, which reads its rows in the order of (length, hash)
and spills only between two keys.

Rows find their owner by SHA-256; the few texts that many rows share are joined by
broadcast (common.heavy_join). Null texts count as empty; empty texts equal each other.
A null doc_id comes after every other. Of rows that are alike in doc_id and text, one is
kept. Extra columns, of whatever name, pass through untouched; an empty table gives an
empty result. doc_id must be a number or null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TRIE_BYTES = 32_000_000
NO_ID = (1 << 63) - 1  # stands for a null doc_id in comparisons


class Node:
    __slots__ = ("edge", "kids", "owner")

    def __init__(self, edge: bytes, owner=None):
        self.edge, self.owner = edge, owner
        self.kids: dict[int, Node] = {}


def _common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of a and b[start:], by halving."""
    low, high = 0, min(len(a), len(b) - start)
    while low < high:
        mid = (low + high + 1) // 2
        if b.startswith(a[low:mid], start + low):
            low = mid
        else:
            high = mid - 1
    return low


class Patricia:
    """A compressed radix trie over whole byte strings; owners merge at terminals.

    An owner is (-code points, doc_id, row number, rows): the smallest wins, rows add up.
    """

    def __init__(self, limit: int = TRIE_BYTES):
        self.root, self.held, self.limit = Node(b""), 0, limit

    @staticmethod
    def merge(a: tuple, b: tuple) -> tuple:
        return (*min(a[:3], b[:3]), a[3] + b[3])

    def insert(self, key: bytes, owner: tuple) -> None:
        node, at = self.root, 0
        while True:
            if at == len(key):
                node.owner = owner if node.owner is None else self.merge(node.owner, owner)
                return
            kid = node.kids.get(key[at])
            if kid is None:
                node.kids[key[at]] = Node(key[at:], owner)
                self.held += len(key) - at + 200
                return
            if key.startswith(kid.edge, at):
                node, at = kid, at + len(kid.edge)
                continue
            n = _common(kid.edge, key, at)
            upper = Node(kid.edge[:n])
            kid.edge = kid.edge[n:]
            upper.kids[kid.edge[0]] = kid
            node.kids[key[at]] = upper
            self.held += 200
            node, at = upper, at + n

    def _walk(self, node: Node, prefix: bytes) -> Iterator[tuple[bytes, tuple]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            prefix += node.edge
            if node.owner is not None:
                yield prefix, node.owner
            stack.extend((k, prefix) for k in node.kids.values())

    def empty(self) -> Iterator[tuple[bytes, tuple]]:
        """Every (text, owner); the trie is empty afterwards."""
        yield from self._walk(self.root, b"")
        self.root, self.held = Node(b""), 0

    def spill(self) -> Iterator[tuple[bytes, tuple]]:
        """While over the limit, take out the largest subtree below the root."""
        while self.held > self.limit and self.root.kids:
            weigh = {b: self._bytes(k) for b, k in self.root.kids.items()}
            b = max(weigh, key=lambda x: (weigh[x], x))
            yield from self._walk(self.root.kids.pop(b), b"")
            self.held -= weigh[b]

    @staticmethod
    def _bytes(node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node.edge) + 200
            stack.extend(node.kids.values())
        return total


def normalised(text: str | None) -> bytes:
    return (text or "").encode("utf-8").translate(None, common.BLANKS.encode())


MADE = "kind int, length long, content_hash long, body binary, code_points long, doc_id long, row long, n_rows long, text_sha256 string"
MADE_KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
OWNERS = "text_sha256 string, keep_id long, keep_row long, group_size long"


def _content_hash(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key) - (1 << 63)


def _made(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(MADE_KINDS)
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, MADE_KINDS, strict=True)], names=[x.split()[0] for x in MADE.split(", ")])


def _partial(numbered: bool):
    """Rows (kind 0) and partial owners with their full strings (kind 1) of a task's
    documents (doc_id, text, and the row's number if numbered)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, row = Patricia(), TaskContext.get().partitionId() << 33

        def owners(found: Iterator[tuple[bytes, tuple]]) -> Iterator[pa.RecordBatch]:
            out, held = [], 0
            for k, o in found:
                out.append((1, len(k), _content_hash(k), k, -o[0], o[1], o[2], o[3], None))
                held += len(k)
                if held > 4_000_000:
                    yield _made(out)
                    out, held = [], 0
            yield _made(out)

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            places = b.column(2).to_pylist() if numbered else range(row, row + len(ids))
            row += len(ids)
            out = []
            for doc_id, text, place in zip(ids, texts, places, strict=True):
                key, points = normalised(text), len(text or "")
                trie.insert(key, (-points, NO_ID if doc_id is None else doc_id, place, 1))
                out.append((0, None, None, None, points, doc_id, place, None, hashlib.sha256(key).hexdigest()))
            yield _made(out)
            if trie.held > trie.limit:
                yield from owners(trie.spill())
        yield from owners(trie.empty())

    return run


def _final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial owners in the order of (length, content hash) -> owners. Strings of all
    keys of the task share a trie; once a key is past, its strings are settled, so that
    what spills when the next key begins is final."""
    trie, key = Patricia(), None

    def settled(found: Iterator[tuple[bytes, tuple]]) -> pa.RecordBatch:
        out = [(hashlib.sha256(k).hexdigest(), None if o[1] == NO_ID else o[1], o[2], o[3]) for k, o in found]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in OWNERS.split(", ")])

    for b in batches:
        for length, chash, body, points, doc_id, row, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (length, chash) != key:
                if trie.held > trie.limit:
                    yield settled(trie.spill())
                key = (length, chash)
            trie.insert(body, (-points, doc_id, row, n))
    yield settled(trie.empty())


def settle(docs: DataFrame, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, owners) of documents (doc_id, text), both written to the shared folder.

    rows: doc_id, row, text_sha256; owners: a row per distinct normalised text with its
    SHA-256, the row that stays (keep_id, keep_row) and the number of rows. `row` names a
    long column that numbers the rows; without it they are numbered by task and place.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([F.col(row).alias("row")] if row else []))
    path = common.scratch_path(spark, "texts")
    given.mapInArrow(_partial(row is not None), MADE).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    made = spark.read.schema(MADE).parquet(path)
    parts = made.where("kind = 1").select("length", "content_hash", "body", "code_points", "doc_id", "row", "n_rows")
    dealt = parts.repartition("length", "content_hash").sortWithinPartitions("length", "content_hash")
    owners = common.written(dealt.mapInArrow(_final, OWNERS), "owners")
    return made.where("kind = 0").select("doc_id", "row", "text_sha256"), owners


def exact_groups(docs: DataFrame, row: str | None = None) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256, row (its number)."""
    rows, owners = settle(docs, row)
    out = common.heavy_join(rows, owners.withColumn("n", F.col("group_size")), "text_sha256", "n")
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256", "row")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of documents that stay, with all their columns. Where doc_id does not
    name a row, rows are numbered in a written copy; the number only decides between
    rows that are alike in code points and doc_id."""
    if common.has_unique_ids(docs):
        stay = exact_groups(docs).where("kept").select("doc_id")
        return docs.join(stay, "doc_id", "left_semi").select(*docs.columns)
    (row,) = common.free_names(docs, ["row"])
    marked = common.written(docs.withColumn(row, common.monotone()), "rows")
    stay = exact_groups(marked, row).where("kept").select(F.col("row").alias(row))
    return marked.join(stay, row, "left_semi").select(*docs.columns)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row of its group that stays."""
    return exact_groups(common.documents(spark, sf_dir)).drop("row")


QUERIES = {"op5_exact_dedup": op5_exact_dedup}
ORACLE_SQL = {
    "op5_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
), r AS (
  SELECT doc_id, sha256(body) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY length(text) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
}
