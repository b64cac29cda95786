"""Line dedup that can be undone: an index of lines in shards.

A line's key is the line without blanks at both ends, A-Z in lower case; keys of LEAST code
points or more are indexed under their BLAKE2 digest of 16 bytes. The index has, below one
path of the shared folder and under the number of the change that wrote it,

* ``references``: a row per document and distinct key, in the change that brought it;
* ``counts``: the exact reference-count table: per key how many documents hold it and the
  smallest doc_id of them; a change writes only the keys it touches, and the newest row of a
  key holds (0: nobody holds it any more);
* ``filters``: per shard (by digest) cuckoo filters of the keys that somebody holds, in parts
  of a fixed size. An insertion looks up only keys that a filter may hold; all others are
  new without a look at the tables. A key that nobody holds any more leaves its filter.
* ``removals``: the documents that a deletion took out;
* ``changes``: a row per finished change, written last. What an unfinished one left is not read.

Deleting documents gives lines back: a key's next document becomes its owner. Inserting and
deleting the same documents leaves counts and owners as they were.

Null and empty texts are one empty line. A document is named by its doc_id: rows that share
one are one document with all their lines, and inserting an id again adds to it. Rows with a
null doc_id keep a line only if no document with an id holds it. Texts of any length are
read whole; other columns are ignored; an empty table changes nothing.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Code points of the shortest key that is indexed.
LEAST = 10
SHARDS = 64
#: Buckets (a power of two) and slots of a part of a filter, and how many keys it takes.
BUCKETS, SLOTS = 1 << 14, 4
FILL = BUCKETS * SLOTS * 85 // 100
#: Moves before a key goes to the next part.
KICKS = 200

_BLANKS = common.BLANKS.encode()


def key_of(line: bytes) -> bytes:
    """The key of a UTF-8 line; bytes.lower() changes A-Z only."""
    return line.strip(_BLANKS).lower()


def digest_of(key: bytes, least: int = LEAST) -> bytes | None:
    """The digest under which a key is indexed; None for a shorter one."""
    if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8")) < least):
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


class Cuckoo:
    """A part of a cuckoo filter: a bucket of SLOTS prints of 16 bits, and for each print a
    second bucket that follows from the first and the print alone."""

    def __init__(self, body: bytes | None = None):
        self.slots = np.zeros((BUCKETS, SLOTS), np.uint16) if body is None else np.frombuffer(zlib.decompress(body), np.uint16).reshape(BUCKETS, SLOTS).copy()
        self.held = int(np.count_nonzero(self.slots))

    def body(self) -> bytes:
        return zlib.compress(self.slots.tobytes(), 1)

    @staticmethod
    def places(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Print, first and second bucket of each digest (the shard uses other bytes of it)."""
        x = np.frombuffer(b"".join(digests), "<u4").reshape(-1, 4)
        prints = (x[:, 0] % 65535 + 1).astype(np.int64)
        one = (x[:, 1] % BUCKETS).astype(np.int64)
        return prints, one, one ^ Cuckoo.hop(prints)

    @staticmethod
    def hop(prints):
        return (prints * 0x5BD1E995 >> 7) % BUCKETS

    def may_hold(self, prints: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        p = prints[:, None]
        return (self.slots[one] == p).any(axis=1) | (self.slots[two] == p).any(axis=1)

    def insert(self, print_: int, bucket: int) -> bool:
        """False, with nothing changed, when the key finds no place."""
        if self.held >= FILL:
            return False
        moves: list[tuple[int, int, int]] = []
        for k in range(KICKS):
            free = np.flatnonzero(self.slots[bucket] == 0)
            if len(free):
                self.slots[bucket, free[0]] = print_
                self.held += 1
                return True
            if k:  # the first move only tries the other bucket
                slot = (print_ + k) % SLOTS
                moves.append((bucket, slot, int(self.slots[bucket, slot])))
                self.slots[bucket, slot], print_ = print_, moves[-1][2]
            bucket ^= Cuckoo.hop(print_)
        for b, slot, old in reversed(moves):
            self.slots[b, slot] = old
        return False

    def _place(self, prints: np.ndarray, buckets: np.ndarray) -> np.ndarray:
        """Put prints into free slots of their buckets, the first come first; whether each found one."""
        order = np.argsort(buckets, kind="stable")
        b = buckets[order]
        rank = np.arange(len(b)) - np.searchsorted(b, b)
        taken = self.slots[b] != 0
        ok = rank < SLOTS - taken.sum(axis=1)
        slot = np.argsort(taken, axis=1, kind="stable")[np.arange(len(b)), np.minimum(rank, SLOTS - 1)]
        self.slots[b[ok], slot[ok]] = prints[order][ok]
        self.held += int(ok.sum())
        out = np.zeros(len(b), bool)
        out[order[ok]] = True
        return out

    def insert_many(self, digests: list[bytes]) -> list[bytes]:
        """Insert what finds a place; the others are returned."""
        room = max(0, FILL - self.held)
        now, later = digests[:room], digests[room:]
        if not now:
            return later
        prints, one, two = Cuckoo.places(now)
        left = np.flatnonzero(~self._place(prints, one))
        left = left[~self._place(prints[left], two[left])]
        return [now[i] for i in left.tolist() if not self.insert(int(prints[i]), int(one[i]))] + later

    def remove(self, print_: int, one: int, two: int) -> bool:
        for b in (one, two):
            at = np.flatnonzero(self.slots[b] == print_)
            if len(at):
                self.slots[b, at[0]] = 0
                self.held -= 1
                return True
        return False


def _rows(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def _references(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = {digest_of(key_of(x), least) for x in (text or b"").split(b"\n")}
                out += [(d, doc_id) for d in found if d is not None]
            yield _rows(out, [pa.binary(), pa.int64()], ["digest", "doc_id"])

    return run


def _kept(least: int):
    """(doc_id, text, taken digests) -> the document's digest columns and its kept text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc_id, text, gone in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines, gone = (text or b"").split(b"\n"), set(gone or ())
                kept = lines if not gone else [x for x in lines if digest_of(key_of(x), least) not in gone]
                body = b"\n".join(kept)
                out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256(body).hexdigest(), body))
            yield _rows(out, [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()], ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"])

    return run


_STREAM = ["shard", "part", "digest", "body"]
_PARTS = "shard int, part int, body binary"


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int | None, bytes | None, bytes | None]]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def _probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's filter parts, then its keys -> the keys that a part may hold."""
    shard, parts, keys = None, [], []

    def flush() -> pa.RecordBatch:
        found: list[bytes] = []
        if keys and parts:
            at = Cuckoo.places(keys)
            hit = np.zeros(len(keys), bool)
            for p in parts:
                hit |= p.may_hold(*at)
            found = [k for k, h in zip(keys, hit.tolist(), strict=True) if h]
        keys.clear()
        return pa.record_batch([pa.array(found, pa.binary())], names=["digest"])

    for s, _, digest, body in _by_shard(batches):
        if s != shard:
            yield flush()
            shard, parts = s, []
        if body is not None:
            parts.append(Cuckoo(body))
        else:
            keys.append(digest)
            if len(keys) >= 50_000:
                yield flush()
    yield flush()


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's last filter part (if any), then new keys -> that part and further ones with the keys in them."""
    shard, number, part, keys = None, 0, None, []

    def close(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal number, part, keys
        while keys:
            part = part or Cuckoo()
            keys = part.insert_many(keys)
            if keys:  # full
                yield _rows([(shard, number, part.body())], [pa.int32(), pa.int32(), pa.binary()], ["shard", "part", "body"])
                number, part = number + 1, None
        if last and part is not None:
            yield _rows([(shard, number, part.body())], [pa.int32(), pa.int32(), pa.binary()], ["shard", "part", "body"])

    for s, at, digest, body in _by_shard(batches):
        if s != shard:
            yield from close(True)
            shard, number, part = s, 0, None
        if body is not None:
            number, part = at, Cuckoo(body)
            continue
        keys.append(digest)
        if len(keys) >= 50_000:
            yield from close(False)
    yield from close(True)


def _emptied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's filter parts, then keys that nobody holds -> the parts without them. All
    parts have the same buckets, so a print that two keys share may leave either part."""
    shard, parts = None, {}

    def close() -> pa.RecordBatch:
        return _rows([(shard, n, p.body()) for n, p in parts.items()], [pa.int32(), pa.int32(), pa.binary()], ["shard", "part", "body"])

    for s, at, digest, body in _by_shard(batches):
        if s != shard:
            yield close()
            shard, parts = s, {}
        if body is not None:
            parts[at] = Cuckoo(body)
            continue
        where = [int(x[0]) for x in Cuckoo.places([digest])]
        any(p.remove(*where) for p in parts.values())
    yield close()


class LineIndex:
    """An index of lines below `path`; the same path opens it again."""

    def __init__(self, spark: SparkSession, path: str | None = None, shards: int = SHARDS, least: int = LEAST):
        self.spark, self.path, self.shards, self.least = spark, path or common.scratch_path(spark, "lines"), shards, least

    # What has been written

    def changes(self) -> list[tuple[int, str]]:
        """(number, kind) of the finished changes, in order."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/changes")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return []
        return [tuple(r) for r in self.spark.read.schema("number int, kind string").parquet(f"{self.path}/changes").orderBy("number").collect()]  # a row a change

    def _read(self, what: str, schema: str, kinds: tuple[str, ...] = ("insert", "delete")) -> DataFrame:
        found = [n for n, k in self.changes() if k in kinds]
        if not found:
            return self.spark.createDataFrame([], schema + ", number int")
        return self.spark.read.schema(schema + ", number int").option("basePath", f"{self.path}/{what}").parquet(*[f"{self.path}/{what}/number={n}" for n in found])

    def _write(self, df: DataFrame, what: str, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{what}/number={number}")

    def _finish(self, number: int, kind: str) -> None:
        self.spark.createDataFrame([(number, kind)], "number int, kind string").coalesce(1).write.mode("append").parquet(f"{self.path}/changes")

    def references(self) -> DataFrame:
        """(digest, doc_id) of the documents that are in the index."""
        refs = self._read("references", "digest binary, doc_id long", ("insert",))
        gone = self._read("removals", "doc_id long", ("delete",)).groupBy("doc_id").agg(F.max("number").alias("gone"))
        if not any(k == "delete" for _, k in self.changes()):
            return refs.drop("number")
        return refs.join(gone, refs["doc_id"].eqNullSafe(gone["doc_id"]), "left").where("gone is null or gone < number").select("digest", refs["doc_id"])

    def counts(self) -> DataFrame:
        """(digest, n, owner): documents that hold a key, and the smallest of them."""
        every = self._read("counts", "digest binary, n long, owner long")
        if len(self.changes()) == 1:
            return every.where("n > 0").drop("number")
        newest = every.groupBy("digest").agg(F.max_by(F.struct("n", "owner"), "number").alias("x"))
        return newest.select("digest", "x.n", "x.owner").where("n > 0")

    def _filters(self) -> DataFrame:
        """(shard, part, body) of the newest version of each part."""
        newest = Window.partitionBy("shard", "part").orderBy(F.desc("number"))
        return self._read("filters", _PARTS).withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r", "number")

    def _stream(self, parts: DataFrame, digests: DataFrame) -> DataFrame:
        """A shard's filter parts in order, then its digests, in one task."""
        keys = digests.select(self._shard().alias("shard"), F.lit(None).cast("int").alias("part"), "digest", F.lit(None).cast("binary").alias("body"))
        both = parts.select("shard", "part", F.lit(None).cast("binary").alias("digest"), "body").unionByName(keys)
        return both.repartition("shard").sortWithinPartitions("shard", F.col("part").asc_nulls_last(), "digest").select(*_STREAM)

    def _shard(self):
        """The shard of a digest, by bytes that the filters do not use."""
        return F.pmod(F.conv(F.hex(F.substring("digest", 9, 4)), 16, 10).cast("long"), F.lit(self.shards)).cast("int")

    # Changes

    def insert(self, docs: DataFrame) -> None:
        """Add documents (doc_id, text)."""
        common.small_batches(self.spark)
        done = self.changes()
        number = done[-1][0] + 1 if done else 0
        plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
        self._write(plain.mapInArrow(_references(self.least), "digest binary, doc_id long"), "references", number)
        refs = self.spark.read.schema("digest binary, doc_id long").parquet(f"{self.path}/references/number={number}")
        new = refs.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner"))
        if done:
            new = common.written(new, "batch-counts")
            maybe = common.written(self._stream(self._filters(), new).mapInArrow(_probed, "digest binary"), "maybe")
            old = self.counts().join(maybe, "digest", "left_semi").select("digest", F.col("n").alias("had"), F.col("owner").alias("first"))
            new = new.join(common.written(old, "known"), "digest", "left").select("digest", (F.col("n") + F.coalesce("had", F.lit(0))).alias("n"), F.least("owner", "first").alias("owner"), F.col("had").isNull().alias("fresh"))
        else:
            new = new.withColumn("fresh", F.lit(True))
        self._write(new, "counts", number)
        fresh = self.spark.read.schema("digest binary, fresh boolean").parquet(f"{self.path}/counts/number={number}").where("fresh")
        last = self._filters()
        last = last.join(last.groupBy("shard").agg(F.max("part").alias("part")), ["shard", "part"]) if done else last
        self._write(self._stream(last, fresh).mapInArrow(_filled, _PARTS), "filters", number)
        self._finish(number, "insert")

    def delete(self, ids: DataFrame) -> None:
        """Take out the documents whose doc_id is in ids (doc_id), whatever inserted them."""
        common.small_batches(self.spark)
        done = self.changes()
        if not done:
            return
        number = done[-1][0] + 1
        ids = common.written(ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "removed")
        refs = common.written(self.references(), "references-before")
        same = refs["doc_id"].eqNullSafe(ids["doc_id"])
        touched = common.written(refs.join(ids, same, "left_semi").groupBy("digest").agg(F.count("*").alias("gone")), "touched")
        left = refs.join(ids, same, "left_anti").join(touched.select("digest"), "digest", "left_semi")
        left = left.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("owner"))
        now = touched.join(left, "digest", "left").select("digest", F.coalesce("n", F.lit(0)).alias("n"), "owner", F.lit(False).alias("fresh"))
        self._write(now, "counts", number)
        empty = self.spark.read.schema("digest binary, n long").parquet(f"{self.path}/counts/number={number}").where("n = 0")
        self._write(self._stream(self._filters(), empty).mapInArrow(_emptied, _PARTS), "filters", number)
        self._write(ids, "removals", number)
        self._finish(number, "delete")

    # Reading

    def dropped(self) -> DataFrame:
        """(doc_id, digest) of the lines that a document loses: another one owns them."""
        shared = self.counts().where("n > 1 and owner is not null")
        refs = self.references()
        if len(self.changes()) > 1:
            shared, refs = common.written(shared, "shared"), common.written(refs, "references-now")
        found = common.heavy_join(refs, shared.withColumn("of", F.col("n")), "digest", "of")
        return found.where("not (doc_id <=> owner)").select("doc_id", "digest")

    def deduplicated(self, docs: DataFrame) -> DataFrame:
        """Per row of docs (doc_id, text), documents of the index: doc_id, n_lines, n_dropped, kept_sha256, kept
        (the lines that stay, joined by line ends)."""
        common.small_batches(self.spark)
        gone = self.dropped().groupBy(F.col("doc_id").alias("of")).agg(F.collect_set("digest").alias("gone"))
        plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
        both = plain.join(gone.hint("shuffle_hash"), plain["doc_id"].eqNullSafe(gone["of"]), "left").select("doc_id", "text", "gone")
        out = both.mapInArrow(_kept(self.least), "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept binary")
        return out.withColumn("kept", F.col("kept").cast("string"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents indexed, and what stays of each."""
    docs, index = common.documents(spark, sf_dir), LineIndex(spark)
    index.insert(docs)
    return index.deduplicated(docs).drop("kept")


QUERIES = {"op13_line_dedup": op13_line_dedup}
ORACLE_SQL = {
    "op13_line_dedup": r"""
WITH d AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d
), o AS (
  SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT k.*, o.owner IS NOT NULL AND o.owner <> doc_id AS gone FROM k LEFT JOIN o USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
}
