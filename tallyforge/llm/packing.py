"""Best-fit packing by minimum bin slack.

Only the lengths matter for the packing, and there are at most `capacity` of them.
So the pieces are counted by length, the bins are planned on those counts (a table
that does not grow with the corpus), and every piece finds its bin from its length
and its rank among the pieces of that length.

Planning: the largest length that is left seeds a bin; a subset-sum over bitsets
(Python integers) of the lengths that are left, largest first, finds the fullest
sum that fits beside it; the combination is removed. Removing pieces only takes
combinations away, so a fullest one stays a fullest one for as long as its pieces
last: it is removed as often as its counts allow in one step. Every step uses up
a length or shrinks a count below a combination's need, so the number of steps
is bounded by the lengths, not by the bins.

Null texts count as empty and still hold their end id; a null doc_id is kept as
a row of its own; repeated rows are packed once each; an empty table gives no row.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

END_ID = 2
CAPACITY = 1024
VOCABULARY = "byte_bpe_50k.json"


def fullest(counts: list[int], room: int, start: int) -> list[tuple[int, int]]:
    """Lengths and multiplicities whose sum is as near to `room` as can be, not above.

    counts[n] pieces of length n are left; lengths above `start` are not used.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n in range(min(start, room), 0, -1):
        left, take = min(counts[n], room // n), 1
        while left > 0:  # binary splitting of the multiplicity
            k = min(take, left)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            left -= k
            take *= 2
        if reach >> room:
            break
    at, out = reach.bit_length() - 1, Counter()
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            at -= n * k
            out[n] += k
    return sorted(out.items(), reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (copies, [(length, multiplicity), ...]) that use up the histogram."""
    counts = [0] * (capacity + 1)
    for n, c in histogram.items():
        if not 0 < n <= capacity:
            raise ValueError(f"a piece of length {n} does not fit in {capacity}")
        counts[n] += c
    bins, top = [], capacity
    while True:
        while top and not counts[top]:
            top -= 1
        if not top:
            return bins
        counts[top] -= 1
        parts = Counter({top: 1})
        if capacity > top:
            parts.update(dict(fullest(counts, capacity - top, top)))
        counts[top] += 1
        copies = min(counts[n] // m for n, m in parts.items())
        for n, m in parts.items():
            counts[n] -= copies * m
        bins.append((copies, sorted(parts.items(), reverse=True)))


class Places:
    """For (length, rank) the bin and offset under a plan, vectorised."""

    def __init__(self, bins: list[tuple[int, list[tuple[int, int]]]]):
        rows, first, given = [], 0, Counter()
        for copies, parts in bins:
            offset = 0
            for n, m in parts:
                rows.append((n, given[n], first, m, offset))
                given[n] += copies * m
                offset += n * m
            first += copies
        rows.sort()
        self.n, self.lo, self.first, self.m, self.offset = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = self.n << 50 | self.lo
        at = np.searchsorted(key, length << 50 | rank, side="right") - 1
        within = rank - self.lo[at]
        return self.first[at] + within // self.m[at], self.offset[at] + within % self.m[at] * length


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces, the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The token pieces of documents (doc_id, text); with_ids adds the ids as uint32 bytes."""
    path = vocabulary or tokens.vocabulary(VOCABULARY)
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = tokens.memo(path, True)
        for b in batches:
            ids, ends = memo.flat(b.column(1), END_ID)
            raw, out, first = ids.astype("<u4").tobytes(), [], 0
            for doc_id, end in zip(b.column(0).to_pylist(), ends.tolist(), strict=True):
                for i, (s, n) in enumerate(cut(end - first, capacity)):
                    part = raw[4 * (first + s) : 4 * (first + s + n)]
                    out.append((doc_id, i, s, n, zlib.crc32(part), *([part] if with_ids else ())))
                first = end
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            cols = list(zip(*out, strict=True)) or [[]] * (6 if with_ids else 5)
            names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=names)
        pa.default_memory_pool().release_unused()  # the worker lives on

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES + (", ids binary" if with_ids else ""))


def pack(cut_docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (`length` long and any other columns); where
    the input has such a column the new one gets underscores before its name.

    Ranks within a length are dealt out over salted groups, whose sizes are summed
    first, so a length that a third of all pieces have is not ranked in one task.
    Pieces of one length may take each other's places; which takes which is settled by
    their columns, and between pieces alike in all of them by chance.
    """
    spark = cut_docs.sparkSession
    names = cut_docs.columns
    salt, count, before, rank, place, sequence, offset = common.free_names(cut_docs, ["salt", "count", "before", "rank", "place", "sequence_id", "offset"])
    salts = 4 * common.shuffle_width(spark)
    flat = [F.col(f"`{c}`") for c, kind in cut_docs.dtypes if not kind.startswith(("map", "variant"))]
    salted = common.written(cut_docs.withColumn(salt, F.pmod(F.xxhash64(common.monotone()), F.lit(salts)).cast("int")), "pieces")
    sizes = common.written(salted.groupBy("length", salt).agg(F.count("*").alias(count)), "sizes")
    histogram = {int(r["length"]): int(r["n"]) for r in sizes.groupBy("length").agg(F.sum(count).alias("n")).collect()}  # at most `capacity` rows
    places = spark.sparkContext.broadcast(Places(plan(histogram, capacity)))
    earlier = sizes.withColumn(before, F.sum(count).over(Window.partitionBy("length").orderBy(salt)) - F.col(count)).drop(count)
    inside = F.row_number().over(Window.partitionBy("length", salt).orderBy(*flat)) - 1
    ranked = salted.withColumn(rank, inside.cast("long")).join(earlier, ["length", salt]).withColumn(rank, F.col(rank) + F.col(before))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        where, offset = places.value.find(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": where, "offset": offset})

    found = ranked.withColumn(place, placed("length", rank))
    return found.select(*[F.col(f"`{c}`") for c in names], F.col(place)["sequence_id"].alias(sequence), F.col(place)["offset"].alias(offset))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 ids; a row per piece."""
    return pack(pieces(common.documents(spark, sf_dir)))


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
