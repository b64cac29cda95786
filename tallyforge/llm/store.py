"""A content-addressed store of token ids.

A rolling hash over the last WINDOW ids cuts each document's ids into chunks, so
documents that share a passage share its chunks wherever it stands. The store has

* ``chunks``: each distinct chunk once, under the BLAKE2 digest of its ids;
* ``recipes``: per document, in ascending doc_id order, where its ids start among
  all ids, how many there are, the digests of its chunks, and their Merkle root;
* ``manifest``: per recipe part the number of documents and ids and the root of a hash
  tree over the documents' roots in order.

verify() builds the trees anew and compares them with the manifest. Reading joins recipes
with chunks, puts every document's ids together and raises unless the digests of its
chunks, taken anew, have the document's root; read_checksums() keeps only the CRC-32 of the ids it
put together. A chunk that a third of all documents hold leaves each input task once.
Nothing is addressed by a local path: all parts are Parquet folders below a path that
Spark reads.

Null texts count as empty (their only id is the end id); rows with a null doc_id come
first; rows alike in doc_id stand in the order of their length and root, and rows alike
in these too are told apart by their place; extra columns are ignored; an empty table
gives a store without rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
WINDOW, LEAST, MOST, MASK = 8, 64, 2048, 255
#: Bytes of texts that are tokenised at once, so that their pieces are looked up once.
GATHERED = 8 << 20
#: Pieces that a worker of this operator remembers: it holds little else.
MEMO_PIECES = 1_200_000
#: Digests that a task remembers to leave out chunks it has already sent.
SEEN = 100_000
#: Nodes under one node of the manifest's hash trees, and levels of them.
FANOUT, LEVELS = 4096, 3


def rolling(ids: np.ndarray) -> np.ndarray:
    """For each place a hash of the WINDOW ids that end there (earlier places wrap to zero)."""
    g = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    g ^= g >> np.uint64(29)
    h = g.copy()
    power = np.uint64(1)
    for j in range(1, min(WINDOW, len(ids))):
        power = np.uint64(int(power) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)
        h[j:] += g[:-j] * power
    return h


def boundaries(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of each of the documents that end at `ends` in ids. The hash
    runs over all documents at once: it reaches over a document's start only where no
    chunk can end yet (WINDOW < LEAST)."""
    marks = np.flatnonzero((rolling(ids) >> np.uint64(40)) & np.uint64(MASK) == 0) + 1
    reach = np.searchsorted(marks, np.concatenate([[0], ends]), side="right").tolist()
    marks, out, start = marks.tolist(), [], 0
    for i, end in enumerate(ends.tolist()):
        stops, last = [], start
        for m in marks[reach[i] : reach[i + 1]]:
            while m - last > MOST:
                last += MOST
                stops.append(last)
            if m - last >= LEAST and m < end:
                stops.append(m)
                last = m
        while end - last > MOST:
            last += MOST
            stops.append(last)
        if end > last:
            stops.append(end)
        out.append(stops)
        start = end
    return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document's ids."""
    return boundaries(ids, np.array([len(ids)]))[0]


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up as it is."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves] or [b"\0" * 16]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def unsqueeze(body: bytes) -> bytes:
    """A stored chunk's uint32 ids: the first byte is the width of the stored ones. Bodies
    are left to the compression of shuffles and files, which sees many at a time."""
    return np.frombuffer(body, "<u2", offset=1).astype("<u4").tobytes() if body[0] == 2 else body[1:]


ROWS = "kind int, digest binary, body binary, doc_id long, n_tokens long, digests array<binary>, root binary"
KINDS = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary()]
RECIPES = "doc_id long, n_tokens long, digests array<binary>, root binary, part int, place long, start long"
MANIFEST = "part int, n_docs long, n_ids long, root binary"


def _batch(rows: list[tuple], kinds: list, ddl: str) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in ddl.split(", ")])


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, as many in one as have GATHERED bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= GATHERED:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _encoder(path: str, spaced: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = tokens.memo(path, spaced, MEMO_PIECES)
        seen: set[bytes] = set()
        for b in _gathered(batches):
            ids, ends = memo.flat(b.column(1), END_ID)
            docs, ends = b.column(0).to_pylist(), np.concatenate([[0], ends])
            for i in range(0, len(docs), common.BATCH_ROWS):
                some = ends[i : i + common.BATCH_ROWS + 1]
                yield _batch(_chunked(docs[i : i + common.BATCH_ROWS], ids[some[0] : some[-1]], some[1:] - some[0], seen), KINDS, ROWS)
        pa.default_memory_pool().release_unused()  # the worker lives on

    return run


def _chunked(docs: list[int | None], ids: np.ndarray, ends: np.ndarray, seen: set[bytes]) -> list[tuple]:
    """ROWS of documents that end at `ends` in ids: new chunks, and a recipe each."""
    raw = ids.astype("<u4").tobytes()
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4  # of the stored ids; the first byte of a body says it
    short, mark = ids.astype(f"<u{width}").tobytes(), bytes([width])
    out, last = [], 0
    for doc_id, stops in zip(docs, boundaries(ids, ends), strict=True):
        digests, n = [], stops[-1] - last
        for stop in stops:
            digests.append(d := digest(raw[4 * last : 4 * stop]))
            if d not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(d)
                out.append((1, d, mark + short[width * last : width * stop], None, None, None, None))
            last = stop
        out.append((0, None, None, doc_id, n, digests, merkle(digests)))
    return out


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by digest, the first of each; rows without a digest all pass."""
    last = None
    for b in batches:
        keep = []
        for i, d in enumerate(b.column(1).to_pylist()):
            if d is None or d != last:
                keep.append(i)
            last = d
        yield b.take(pa.array(keep, pa.int64()))


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, place, start = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        n = np.asarray(b.column(1).to_numpy(zero_copy_only=False), np.int64)
        ends = start + np.cumsum(n)
        more = [pa.array(np.full(len(n), part, np.int32)), pa.array(place + np.arange(len(n), dtype=np.int64)), pa.array(ends - n)]
        if len(n):
            place, start = place + len(n), int(ends[-1])
        yield pa.record_batch([*b.columns, *more], names=[x.split()[0] for x in RECIPES.split(", ")])


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, spaced: bool = False) -> str:
    """Write documents (doc_id, text) to a new store below path; returns the path."""
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = rows.mapInArrow(_encoder(vocabulary or tokens.vocabulary(VOCABULARY), spaced), ROWS)
    dealt = made.repartition(F.when(F.col("kind") == 1, F.xxhash64("digest")).otherwise(F.xxhash64("doc_id", "root")))
    parts = dealt.sortWithinPartitions("kind", "digest").mapInArrow(_once, ROWS)
    parts.write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/made")
    recipes = spark.read.schema(ROWS).parquet(f"{path}/made").where("kind = 0").select("doc_id", "n_tokens", "digests", "root")
    ordered = recipes.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions("doc_id", "n_tokens", "root")
    ordered.mapInArrow(_placed, RECIPES).write.option("compression", "zstd").parquet(f"{path}/recipes")
    _manifest(spark, path).write.parquet(f"{path}/manifest")
    return path


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """Per recipe part n_docs, n_ids and the root of a hash tree over the documents'
    roots in order: FANOUT nodes make one of the level above, LEVELS levels in all, so
    no group holds more than FANOUT nodes (a part of over FANOUT**LEVELS documents has
    more roots than one and a row for each)."""
    r = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    level = r.select("part", "place", "root", F.lit(1).cast("long").alias("n_docs"), F.col("n_tokens").alias("n_ids"))
    for _ in range(LEVELS):
        below = F.transform(F.array_sort(F.collect_list(F.struct("place", "root"))), lambda x: F.hex(x["root"]))
        level = level.groupBy("part", F.floor(F.col("place") / FANOUT).alias("place")).agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_ids").alias("n_ids"), F.unhex(F.sha2(F.array_join(below, "").cast("binary"), 256)).alias("root")
        )
    return level.select("part", "n_docs", "n_ids", "root")


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with `start` counted over all documents before; the sums over the parts
    are one row per file part in one task."""
    r = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    sizes = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    offsets = sizes.select("part", (F.sum("n_ids").over(Window.orderBy("part")) - F.col("n_ids")).alias("before"))
    return r.join(offsets, "part").withColumn("start", F.col("start") + F.col("before")).drop("before")


SUMS = "doc_id long, start long, n_tokens long, ids_crc32 long"
READ = "doc_id long, part int, place long, start long, n_tokens long, ids binary"


def _assembler(sums: bool):
    """Documents from their recipes and chunks; with sums the CRC-32 of the ids that were
    put together in their place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, lists = [], b.column(6)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            found = lists.flatten()  # of all documents in turn; a null list has none
            order = np.lexsort((found.field("pos").to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)))
            bodies = found.field("body").take(pa.array(order)).to_pylist()
            stops = np.cumsum(sizes).tolist()
            for doc_id, part, place, start, n, root, a, z in zip(*(c.to_pylist() for c in b.columns[:6]), [0, *stops], stops, strict=False):
                try:
                    parts = [unsqueeze(x) for x in bodies[a:z]]
                except (IndexError, ValueError) as e:
                    raise ValueError(f"document {doc_id} differs from its recipe: {e}") from e
                ids = b"".join(parts)
                if len(ids) != 4 * n or merkle([digest(x) for x in parts]) != root:  # the root names every chunk's digest
                    raise ValueError(f"document {doc_id} differs from its recipe")
                out.append((doc_id, start, n, zlib.crc32(ids)) if sums else (doc_id, part, place, start, n, ids))
            kinds = [pa.int64()] * 4 if sums else [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield _batch(out, kinds, SUMS if sums else READ)

    return run


def _whole(spark: SparkSession, path: str) -> DataFrame:
    common.small_batches(spark)
    chunks = spark.read.schema(ROWS).parquet(f"{path}/made").where("kind = 1").select("digest", "body")
    r = read_recipes(spark, path)
    refs = r.select("part", "place", F.posexplode("digests").alias("pos", "digest"))
    found = refs.join(chunks, "digest").groupBy("part", "place").agg(F.collect_list(F.struct("pos", "body")).alias("chunks"))
    whole = r.select("doc_id", "part", "place", "start", "n_tokens", "root").join(found, ["part", "place"], "left")
    return whole.select("doc_id", "part", "place", "start", "n_tokens", "root", "chunks")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents put together from the store: doc_id, part, place, start, n_tokens, ids (uint32 bytes)."""
    return _whole(spark, path).mapInArrow(_assembler(False), READ)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Per document doc_id, start, n_tokens and the CRC-32 of its ids, put together as by read_documents()."""
    return _whole(spark, path).mapInArrow(_assembler(True), SUMS)


def verify(spark: SparkSession, path: str) -> DataFrame:
    """Parts whose recipes differ from the manifest, or are on one side only; no row if all is well."""
    facts = F.struct("n_docs", "n_ids", "root")
    now = _manifest(spark, path).select("part", facts.alias("found"))
    then = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").select("part", facts.alias("written"))
    return now.join(then, "part", "full").where(~F.col("found").eqNullSafe(F.col("written")))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Per document the CRC-32 of its ids, put together from the store; raises if a part
    differs from the manifest."""
    bad = [tuple(r) for r in verify(spark, path).select("part").limit(5).collect()]
    if bad:
        raise ValueError(f"parts differ from the manifest: {bad}")
    return read_checksums(spark, path)


def op8_content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to a store and read back."""
    path = write_store(common.documents(spark, sf_dir), common.scratch_path(spark, "store"))
    return read_back(spark, path)


QUERIES = {"op8_content_store": op8_content_store}
