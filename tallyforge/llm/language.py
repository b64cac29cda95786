"""Language identification by compression.

Per language a raw-content zstandard dictionary of DICT_BYTES is filled from a
bounded sample: at most SAMPLE_ROWS labelled documents of the language in the order
of a hash of their ids, each giving an equal share of the dictionary from a place that
the hash chooses. The whole lower-cased text is cut into blocks of BLOCK bytes, repeats
and all, and every block is compressed under each dictionary; the language with the
smallest total wins, ties go to the more frequent language of the training rows, then to
the smaller name. A text is rejected when the runner-up needs less than MARGIN more bytes
than the winner.

The score is the winner's share of 2**(-bytes / 2) among the languages. A null text
or one without a letter is `und` with score 0, and is rejected; so is everything when
no labelled row is there to learn from. Whole texts are read, whatever their length;
repeated rows are judged alike; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SAMPLE_ROWS = 256
DICT_BYTES = 64_000
LEVEL = 6
BLOCK = 2_048
MARGIN = 0.002
UNKNOWN = "und"


def fit(docs: DataFrame, usable: Column) -> list[tuple[str, bytes]]:
    """(language, dictionary) by falling frequency, learnt from documents (doc_id,
    text, lang) where `usable` is true and text and lang are not null."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    shares = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.select("doc_id", "lang").withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= SAMPLE_ROWS).select("doc_id", "lang")
    # at most SAMPLE_ROWS ids per language are sent out, and as many texts come back
    found = rows.select("doc_id", "lang", "text").join(F.broadcast(ids), ["doc_id", "lang"], "left_semi")
    # each sampled text gives an equal share of its language's dictionary
    size = {lang: -(-DICT_BYTES // min(n, SAMPLE_ROWS)) for lang, n in shares.items()}
    wide = F.coalesce(*[F.when(F.col("lang") == lang, n) for lang, n in size.items()], F.lit(0))
    at = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - wide, F.lit(1)))
    share = F.substring(F.col("text"), (at + 1).cast("int"), wide)
    sample = found.select("lang", "doc_id", share.alias("share")).withColumn("h", F.xxhash64("doc_id")).collect()
    out = []
    for lang in sorted(shares, key=lambda x: (-shares[x], x)):
        own = sorted((r for r in sample if r["lang"] == lang), key=lambda r: (r["h"], r["doc_id"], r["share"]))
        parts = [" ".join(r["share"].lower().split()).encode("utf-8")[: size[lang]] for r in own]
        out.append((lang, b"\n".join(parts)[:DICT_BYTES]))
    return out


class Judge:
    """Compressed sizes of texts under each language's dictionary."""

    def __init__(self, model: list[tuple[str, bytes]]):
        self.names = [name for name, _ in model]
        self.under = []
        for _, content in model:
            # a dictionary of fewer than 8 bytes is no dictionary to the library
            d = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.under.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> list[int]:
        raw = text.lower().encode("utf-8")
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.under]

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)"""
        if not self.names or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        score = 1 / sum(2.0 ** max(-60.0, (sizes[best] - s) / 2) for s in sizes)
        rest = min((s for i, s in enumerate(sizes) if i != best), default=None)
        return self.names[best], score, rest is not None and rest - sizes[best] < MARGIN * sizes[best]


def classify(docs: DataFrame, model: list[tuple[str, bytes]], text: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with (lang_pred, score, rejected); the names they got come second."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(lists: Iterator[list]) -> Iterator[list]:
        judge = Judge(sent.value)
        for texts in lists:
            out = [judge(t) for t in texts]
            yield [pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))]

    return common.appended(docs, text, run, [("lang_pred", "string"), ("score", "double"), ("rejected", "boolean")])


def learnable(doc_id: Column) -> Column:
    return common.crc_mod(doc_id, 3) != 1


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language is told with a margin, with all their columns."""
    model = fit(docs, learnable(F.col("doc_id")))
    judged, (_, _, rejected) = classify(docs, model)
    return judged.where(~F.col(rejected)).select(*docs.columns)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from those that are not held out."""
    docs = common.documents(spark, sf_dir)
    model = fit(docs, learnable(F.col("doc_id")))
    judged, _ = classify(docs.select("doc_id", "text"), model)
    held = F.coalesce(common.crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return judged.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op2_language_id": op2_language_id}
