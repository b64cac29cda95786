"""How the words of each source differ from those of its language.

Documents count in two passes. The first builds, per task, a count-min sketch of how many
documents of a language hold a term, its counters capped at the wanted minimum; sketches
merge by capped addition and never underestimate. A term with a cell below the minimum
cannot be kept, so the second pass discards it before anything is shuffled; the survivors
are counted exactly, and only exact counts decide.

Shares are whole numbers of a billionth with one count added to each, and the divergence of
a share p from a share q is floor((p - q)^2 / q). A sum over all kept terms of a language is
never laid out: with b the share of a term that a source lacks,

    sum f(pa, pb) = sum over terms in both of f(pa, pb) - f(pa, bb) - f(ba, pb) + f(ba, bb)
                  + sum over terms of a of f(pa, bb) + sum over terms of b of f(ba, pb)
                  + (V - |a| - |b|) f(ba, bb)

so a sparse join over shared terms and histograms of shares give it exactly.

Null texts, languages and sources count as empty strings; every row is a document of its
own, whatever its doc_id; a text of any length is read in blocks; ties stand in UTF-8 order
of their item; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Cells of a row of the sketch and rows; merged, a cell is one bit, 4 MB in all.
WIDTH, DEPTH = 1 << 23, 4
#: Cells of a piece of the sketch that travels by itself.
SLICE = 1 << 16
#: Parts in which the tasks' pieces of one slice merge first.
SALTS = 64
#: Bytes of texts whose terms are counted together; a longer text is counted by itself.
LOT = 16 << 20
#: Rows of a batch that a task sends.
SENT = 50_000
#: Bytes of a text that are split at once.
BLOCK = 1 << 20
#: Most (lang, source) groups whose totals are broadcast; more are joined by shuffle.
FEW_GROUPS = 100_000
#: Sources of a language that meet the others of a term in one task.
SOURCES_A_TASK = 512
#: A share of one.
WHOLE = 1_000_000_000

_SMALL = bytes(range(97, 123))
#: Letters of ASCII in lower case and all bytes above it as they are; blanks for the rest.
_TERM_BYTES = bytes(c if c >= 128 or c in _SMALL else c + 32 if c + 32 in _SMALL else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text in order, in lists of a block each."""
    clean, start = text.translate(_TERM_BYTES), 0
    while start < len(clean):
        end = clean.find(b" ", start + BLOCK)
        end = len(clean) if end < 0 else end
        yield clean[start:end].split()
        start = end


def cells(lang: bytes, found: list[bytes], width: int = WIDTH, depth: int = DEPTH) -> np.ndarray:
    """Per term its cell in each row of the sketch, numbered through all rows."""
    seed = xxhash.xxh3_64_intdigest(lang)
    h = np.fromiter((xxhash.xxh3_64_intdigest(t, seed) for t in found), np.uint64, len(found))
    step = (h >> np.uint64(32)) | np.uint64(1)
    rows = np.arange(depth, dtype=np.uint64)[:, None]
    return ((h + rows * step) % np.uint64(width) + rows * np.uint64(width)).astype(np.int64)


def add(sketch: np.ndarray, at: np.ndarray, counts: np.ndarray, most: int) -> None:
    """Add counts[i] to the cells at[:, i], each cell capped at `most`."""
    where, back = np.unique(at.ravel(), return_inverse=True)
    more = np.bincount(back, weights=np.minimum(np.tile(counts, len(at)), most))
    sketch[where] = np.minimum(sketch[where] + np.minimum(more, most).astype(np.int64), most).astype(np.uint8)


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in lots of at most LOT bytes of text, or of one text."""
    held, size = [], 0
    for b in batches:
        start = 0
        for i, n in enumerate(pc.binary_length(b.column(2)).to_pylist()):
            if size + n > LOT and (held or i > start):
                held.append(b.slice(start, i - start))
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, size, start = [], 0, i
            size += n
        held.append(b.slice(start))
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _found(texts: pa.BinaryArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of a lot (UTF-8) and, per text and term of it, the numbers of both and how often it is there."""
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1]
    if n == 1 and ends[1] - ends[0] > LOT:
        counts: Counter = Counter()
        for found in terms(texts[0].as_py()):
            counts.update(found)
        return pa.array(list(counts), pa.binary()), np.zeros(len(counts), np.int64), np.arange(len(counts)), np.fromiter(counts.values(), np.int64, len(counts))
    body = bytes(memoryview(texts.buffers()[2] or b"")[ends[0] : ends[-1]]).translate(_TERM_BYTES)
    cut = pc.ascii_split_whitespace(pa.StringArray.from_buffers(n, pa.py_buffer((ends - ends[0]).astype(np.int32)), pa.py_buffer(body)))
    words = cut.flatten().dictionary_encode()
    names, v = words.dictionary, max(1, len(words.dictionary))
    key = np.repeat(np.arange(n, dtype=np.int64) * v, pc.list_value_length(cut).to_numpy())
    key += words.indices.to_numpy()
    del cut, words, body
    key, count = np.unique(key, return_counts=True)
    text, term = key // v, key % v
    empty = pc.index(names, pa.scalar("")).as_py()  # beside blanks at the ends
    if empty >= 0:
        full = term != empty
        text, term, count = text[full], term[full], count[full]
    return names.cast(pa.binary()), text, term, count


def _codes(values: pa.Array) -> tuple[list[bytes], np.ndarray]:
    coded = values.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)


def _sketched(least: int, width: int, depth: int, slice_: int, salts: int):
    """Documents (lang, source, text) as bytes -> the pieces of the task's sketch that are not empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(width * depth, np.uint8)
        for b in _lots(batches):
            names, text, term, _ = _found(b.column(2))
            langs, lang = _codes(b.column(0))
            key, docs = np.unique(lang[text] * max(1, len(names)) + term, return_counts=True)
            for i, name in enumerate(langs):
                a, z = np.searchsorted(key, [i * max(1, len(names)), (i + 1) * max(1, len(names))])
                if a < z:
                    own = names.take(pa.array(key[a:z] % len(names))).to_numpy(zero_copy_only=False).tolist()
                    add(sketch, cells(name, own, width, depth), docs[a:z], least)
        out = []
        salt = TaskContext.get().partitionId() % salts
        for i in range(0, width * depth, slice_):
            if (piece := sketch[i : i + slice_]).any():
                out.append((i // slice_, salt, zlib.compress(piece.tobytes(), 1)))
        yield _pieces(out)
        pa.default_memory_pool().release_unused()  # the worker lives on

    return run


_PIECES = "slice int, salt int, body binary"


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["slice", "salt", "body"])


def _merged(least: int, last: bool):
    """Pieces -> one a slice of those in this task, whichever order they come in; the last
    merge keeps one bit a cell, whether it reached `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            for i, salt, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                piece = np.frombuffer(zlib.decompress(body), np.uint8)
                key = (i, 0 if last else salt)
                held[key] = np.minimum(held[key] + piece, least).astype(np.uint8) if key in held else piece
        pack = (lambda x: np.packbits(x >= least).tobytes()) if last else (lambda x: zlib.compress(x.tobytes(), 1))
        for (i, salt), x in held.items():
            yield _pieces([(i, salt, pack(x))])

    return run


def possible(docs: DataFrame, least: int, width: int = WIDTH, depth: int = DEPTH) -> bytes:
    """A bit per cell of the merged sketch of documents (lang, source, text as bytes): whether
    it counts `least` documents. width * depth / 8 bytes, whatever the input.

    Pieces of all tasks merge in two steps, by slice and salt and then by slice, so that
    no task unpacks the pieces of all tasks.
    """
    slice_ = min(SLICE, width)
    pieces = docs.mapInArrow(_sketched(least, width, depth, slice_, SALTS), _PIECES)
    some = pieces.repartition("slice", "salt").mapInArrow(_merged(least, False), _PIECES)
    whole = some.repartition("slice").mapInArrow(_merged(least, True), _PIECES).select("slice", "body").collect()  # width * depth bits
    out = bytearray(width * depth // 8)
    for i, body in whole:
        out[i * slice_ // 8 : (i + 1) * slice_ // 8] = body
    return bytes(out)


_COUNTS = "lang string, source string, term string, n long, n_docs long"


def _counted(bits, width: int, depth: int):
    """Documents -> partial (lang, source, term, n, n_docs) of the terms that the sketch does
    not rule out, and a row without a term per group of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, groups = np.frombuffer(bits.value, np.uint8), set()

        def rows(langs: pa.Array, sources: pa.Array, found: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([*(x.cast(pa.string()) for x in (langs, sources, found)), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "n_docs"])

        def possible_terms(langs: list[bytes], names: pa.Array, lang: np.ndarray, term: np.ndarray) -> np.ndarray:
            """Per row whether the sketch leaves the term to the language."""
            v = len(names)
            key, back = np.unique(lang * v + term, return_inverse=True)
            may = np.zeros(len(key), bool)
            for i, name in enumerate(langs):
                a, z = np.searchsorted(key, [i * v, (i + 1) * v])
                if a < z:
                    at = cells(name, names.take(pa.array(key[a:z] % v)).to_numpy(zero_copy_only=False).tolist(), width, depth)
                    may[a:z] = ((known[at >> 3] >> (7 - (at & 7))) & 1).all(axis=0)
            return may[back]

        for b in _lots(batches):
            names, text, term, count = _found(b.column(2))
            (langs, lang), (sources, source) = _codes(b.column(0)), _codes(b.column(1))
            group = lang * len(sources) + source
            groups.update((langs[g // len(sources)], sources[g % len(sources)]) for g in np.unique(group).tolist())
            if not len(term):
                continue
            key, back, docs = np.unique(group[text] * len(names) + term, return_inverse=True, return_counts=True)
            n = np.zeros(len(key), np.int64)
            np.add.at(n, back, count)
            group, term = key // len(names), key % len(names)
            may = possible_terms(langs, names, group // len(sources), term)
            group, term, n, docs = group[may], term[may], n[may], docs[may]
            langs, sources = pa.array(langs, pa.binary()), pa.array(sources, pa.binary())
            for i in range(0, len(term), SENT):
                g = group[i : i + SENT]
                yield rows(langs.take(pa.array(g // len(sources))), sources.take(pa.array(g % len(sources))), names.take(pa.array(term[i : i + SENT])), n[i : i + SENT], docs[i : i + SENT])
        if groups:
            langs, sources = zip(*groups, strict=True)
            yield rows(pa.array(langs, pa.binary()), pa.array(sources, pa.binary()), pa.nulls(len(groups), pa.binary()), np.zeros(len(groups), np.int64), np.zeros(len(groups), np.int64))
        pa.default_memory_pool().release_unused()  # the worker lives on

    return run


def kept_counts(docs: DataFrame, least: int = 3, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """(lang, source, term, n, n_lang, leads) of every term that a language keeps, in each of
    its sources that has it, and a row with a null term per (lang, source). n_lang is the
    count in the language; leads marks one row per (lang, term). Written to the shared folder.

    A task sends a (lang, source, term) once for what it holds, so no key has more rows than
    tasks and sources; one exchange by (lang, term) serves both levels of counts.
    """
    common.small_batches(docs.sparkSession)
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("lang", "source", "text")])
    bits = docs.sparkSession.sparkContext.broadcast(possible(plain, least, width, depth))
    n = plain.mapInArrow(_counted(bits, width, depth), _COUNTS).repartition("lang", "term")
    n = n.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    w = Window.partitionBy("lang", "term")
    n = n.withColumns({"docs_lang": F.sum("n_docs").over(w), "n_lang": F.sum("n").over(w), "leads": F.col("source") == F.min("source").over(w)})
    return common.written(n.where(f"docs_lang >= {int(least)} or term is null").select("lang", "source", "term", "n", "n_lang", "leads"), "kept-terms")


def share(n: str, total: str, v: str) -> Column:
    """1 + floor(WHOLE * (n + 1) / (total + v)), exact beyond the range of a long."""
    return F.expr(f"1 + ((cast({n} + 1 as decimal(20, 0)) * cast({WHOLE} as decimal(10, 0))) div cast({total} + {v} as decimal(20, 0)))")


def f(p: str, q: str) -> str:
    """floor((p - q)^2 / q) of two columns of shares; they are WHOLE + 1 at most."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def divergence(docs: DataFrame, least: int = 3, top: int = 200, width: int = WIDTH, depth: int = DEPTH) -> DataFrame:
    """(lang, source, part, item, value, rank) of documents (lang, source, text).

    Part "pair": every other source of the language with the divergence of the source's
    shares from its shares, summed over all kept terms. Part "term": the first `top` kept
    terms that the source uses more than its language does.
    """
    kept = kept_counts(docs, least, width, depth)
    langs = kept.groupBy("lang").agg(F.coalesce(F.sum(F.when(F.col("term").isNotNull() & F.col("leads"), F.col("n_lang"))), F.lit(0)).alias("total_lang"), F.count(F.when(F.col("term").isNotNull() & F.col("leads"), 1)).alias("v"))
    groups = kept.groupBy("lang", "source").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("term").alias("n_terms"))
    groups = common.written(groups.join(langs, "lang").withColumn("base", F.when(F.col("v") > 0, share("0", "total", "v"))), "groups")
    small = groups.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    beside = F.broadcast if small else (lambda x: x)

    rows = kept.where("term is not null").join(beside(groups), ["lang", "source"])
    shares = rows.select("lang", "source", "term", "base", share("n", "total", "v").alias("p"), share("n_lang", "total_lang", "v").alias("q"))

    more = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(f("p", "q")).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms_part = more.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)

    # Sources of a language in blocks, so that a term of very many sources is met by several tasks.
    blocks = max(1, -(-(groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 0) // SOURCES_A_TASK))
    left = shares.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("base").alias("ba"), F.pmod(F.xxhash64("source"), F.lit(blocks)).alias("block"))
    right = shares.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("base").alias("bb"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))) if blocks > 1 else right.withColumn("block", F.lit(0).cast("long"))
    both = left.join(right, ["lang", "term", "block"]).where("a < b")
    gain = lambda p, q, bp, bq: F.expr(f"{f(p, q)} - {f(p, bq)} - {f(bp, q)} + {f(bp, bq)}")
    both = both.groupBy("lang", "a", "b").agg(F.sum(gain("pa", "pb", "ba", "bb")).alias("ab"), F.sum(gain("pb", "pa", "bb", "ba")).alias("ba"))
    shared = both.select("lang", F.explode(F.array(F.struct("a", "b", F.col("ab").alias("value")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("ba").alias("value")))).alias("x")).select("lang", "x.*")

    others = groups.select("lang", F.col("source").alias("other"), F.col("base").alias("b_other"), F.col("n_terms").alias("n_other"))
    histogram = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    alone = histogram.join(beside(others), "lang").where("source <> other")
    alone = alone.groupBy("lang", "source", "other").agg(F.sum(F.expr(f"m * {f('p', 'b_other')}")).alias("to"), F.sum(F.expr(f"m * {f('b_other', 'p')}")).alias("from"))
    alone = alone.select("lang", F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("other").alias("b"), F.col("to").alias("value")), F.struct(F.col("other").alias("a"), F.col("source").alias("b"), F.col("from").alias("value")))).alias("x")).select("lang", "x.*")

    empty = groups.join(beside(others), "lang").where("source <> other")
    empty = empty.select("lang", F.col("source").alias("a"), F.col("other").alias("b"), F.expr(f"if(v = 0, 0L, (v - n_terms - n_other) * {f('base', 'b_other')})").alias("value"))

    pairs = shared.unionByName(alone).unionByName(empty).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value")
    return pairs.withColumn("rank", F.row_number().over(by)).unionByName(terms_part)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of every language against the others and against its language."""
    return divergence(common.documents(spark, sf_dir))


QUERIES = {"op11_source_divergence": op11_source_divergence}
ORACLE_SQL = {
    "op11_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), t AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n_lang FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 3
), langs AS (
  SELECT l.lang, coalesce(CAST(sum(n_lang) AS HUGEINT), 0) AS total, count(term) AS v FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN kept k ON k.lang = l.lang GROUP BY 1
), n AS (
  SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL
), g AS (
  SELECT l.lang, l.source, coalesce(CAST(sum(n) AS HUGEINT), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) l LEFT JOIN n ON n.lang = l.lang AND n.source = l.source GROUP BY 1, 2
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, k.n_lang, 1 + (1000000000 * (coalesce(n.n, 0) + 1)) // (g.total + l.v) AS p, 1 + (1000000000 * (k.n_lang + 1)) // (l.total + l.v) AS q
  FROM g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // q AS BIGINT) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM every) WHERE part = 'pair' OR rank <= 200
"""
}
