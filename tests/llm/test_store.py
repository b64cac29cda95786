import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyforge.llm import common, store, tokens


def test_boundaries_do_not_depend_on_neighbours():
    r = np.random.default_rng(3)
    docs = [r.integers(0, 49_000, n).astype(np.uint32) for n in (1, 5, 3000, 64, 65, 9000, 2, 700)]
    ends = np.cumsum([len(d) for d in docs])
    for d, end, stops in zip(docs, ends, store.boundaries(np.concatenate(docs), ends), strict=True):
        assert [s - (end - len(d)) for s in stops] == store.cuts(d)


def test_cuts_move_with_content():
    r = np.random.default_rng(2)
    ids = r.integers(0, 49_000, 20_000).astype(np.uint32)
    ends = store.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= store.MOST and sizes[:-1].min() >= store.LEAST
    parts = lambda x: {x[a:b].tobytes() for a, b in zip([0, *store.cuts(x)], store.cuts(x), strict=False)}
    moved = np.concatenate([r.integers(0, 49_000, 77).astype(np.uint32), ids])
    assert len(parts(ids) & parts(moved)) > 0.9 * len(ends)
    assert store.cuts(ids[:0]) == [] and store.cuts(ids[:3]) == [3]


def test_write_and_read(spark, docs):
    long = " ".join(f"word{i % 977} and" for i in range(4000))
    rows = [(5, "b c"), (1, None), (3, long), (4, "x " + long), (4, "x " + long), (2, ""), (None, "first"), (9, "<|endoftext|> Q")]
    path = store.write_store(docs(rows), common.scratch_path(spark, "test"))
    got = sorted(store.read_documents(spark, path).collect(), key=lambda r: r["start"])
    tok = Tokenizer.from_file(tokens.vocabulary(store.VOCABULARY))
    want = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for i, t in rows}
    assert [r["doc_id"] for r in got] == [None, 1, 2, 3, 4, 4, 5, 9]
    at = 0
    for r in got:
        assert bytes(r["ids"]) == want[r["doc_id"]] and r["start"] == at and r["n_tokens"] * 4 == len(want[r["doc_id"]])
        at += r["n_tokens"]
    sums = {(r["doc_id"], r["start"], r["n_tokens"]): r["ids_crc32"] for r in store.read_checksums(spark, path).collect()}
    assert sums == {(r["doc_id"], r["start"], r["n_tokens"]): zlib.crc32(bytes(r["ids"])) for r in got}
    chunks = spark.read.schema(store.ROWS).parquet(f"{path}/made").where("kind = 1")
    assert chunks.count() == chunks.select("digest").distinct().count()
    assert store.verify(spark, path).count() == 0


def test_damage_is_found(spark, docs):
    path = store.write_store(docs([(1, "some text here"), (2, "more of it")]), common.scratch_path(spark, "test"))
    r = spark.read.parquet(f"{path}/manifest").withColumn("n_ids", F.lit(7).cast("long"))
    other = common.scratch_path(spark, "test")
    spark.read.parquet(f"{path}/recipes").write.parquet(f"{other}/recipes")
    r.write.parquet(f"{other}/manifest")
    assert store.verify(spark, other).count() >= 1
    damaged = common.scratch_path(spark, "test")
    for name in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{name}").write.parquet(f"{damaged}/{name}")
    made = spark.read.schema(store.ROWS).parquet(f"{path}/made")
    bent = F.when(F.col("kind") == 1, F.concat(F.expr("substring(body, 1, length(body) - 1)"), F.unhex(F.lit("7F")))).otherwise(F.col("body"))
    made.withColumn("body", bent).write.partitionBy("kind").parquet(f"{damaged}/made")
    with pytest.raises(Exception, match="differs from its recipe"):
        store.read_back(spark, damaged).collect()


def test_empty_table(spark, docs):
    path = store.write_store(docs([]), common.scratch_path(spark, "test"))
    assert store.read_documents(spark, path).count() == 0 and store.read_checksums(spark, path).count() == 0


def test_lost_rows_raise_in_the_query(spark, docs):
    path = store.write_store(docs([(i, f"some text {i}") for i in range(6)]), common.scratch_path(spark, "test"))
    want = {r["doc_id"]: r["ids_crc32"] for r in store.read_checksums(spark, path).collect()}
    assert {r["doc_id"]: r["ids_crc32"] for r in store.read_back(spark, path).collect()} == want and len(want) == 6
    for lost in ("doc_id = 3", "true"):  # a row, and all rows of the parts
        other = common.scratch_path(spark, "test")
        for name in ("manifest", "made"):
            spark.read.parquet(f"{path}/{name}").write.partitionBy(*(["kind"] if name == "made" else [])).parquet(f"{other}/{name}")
        spark.read.parquet(f"{path}/recipes").where(f"NOT ({lost})").write.parquet(f"{other}/recipes")
        with pytest.raises(ValueError, match="manifest"):
            store.read_back(spark, other)
