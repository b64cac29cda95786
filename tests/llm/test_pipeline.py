import pytest

import corpus_pipeline
from tallyforge.llm import common, dedup, jaccard, registry


def test_stages_over_a_small_corpus(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    rows = out.collect()
    ids = {r["doc_id"] for r in rows}
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    assert 0 < len(ids) < len(docs)
    texts = ["".join((docs[i] or "").split()) for i in ids]
    assert len(set(texts)) == len(texts)
    assert max(r["offset"] + r["length"] for r in rows) <= 1024
    assert len(corpus_pipeline.STAGES) == 5


def test_each_operator_is_registered():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert registry.oracle_sql().keys() <= names.keys()


LONG = " ".join(f"word{i} and some of the people that were there" for i in range(12))


@pytest.mark.parametrize("parts", [1, 4])
def test_representatives_with_repeated_ids(spark, parts):
    rows = [(5, LONG), (3, LONG), (5, "other words that nobody else has written down"), (None, LONG + " x"), (None, None), (8, "")]
    frame = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, row string, n long").repartition(parts)
    out = jaccard.representatives(frame)
    assert out.columns == frame.columns
    got = out.collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([(3, LONG), (5, rows[2][1]), (None, None), (8, "")], key=str)
    assert {(r["row"], r["n"]) for r in got} == {("k", 1)}


def test_live_frames_survive_a_run(spark, tables):
    docs = common.documents(spark, tables).limit(40)
    mine = jaccard.components(docs)
    corpus_pipeline.run(spark, tables).count()
    assert mine.count() == 40


def test_stages_with_odd_rows(spark, tables):
    """Null ids and texts, repeated ids, extra columns and an empty table through every stage but the last."""
    en = [r["text"] for r in common.documents(spark, tables).where("lang = 'en' and length(text) > 300").limit(6).collect()]
    rows = [(1, en[0]), (1, en[1]), (2, en[0] + " "), (None, en[2]), (None, en[2]), (4, None), (5, ""), (6, en[3])]
    frame = spark.createDataFrame([(i, t, "en", "s", 1, "mine") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, sequence_id string")
    for docs, most in ((frame, len(rows)), (frame.limit(0), 0)):
        for name, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, docs, tables)
            assert out.columns == frame.columns, name
            docs = spark.createDataFrame(out.collect(), frame.schema)
            assert docs.count() <= most and {r["sequence_id"] for r in docs.collect()} <= {"mine"}
        assert corpus_pipeline.STAGES[-1][1](spark, docs, tables).count() >= docs.count()
    kept = dedup.deduplicated(frame).collect()
    assert {(r["doc_id"], r["text"]) for r in kept} == {(2, en[0] + " "), (1, en[1]), (None, en[2]), (4, None), (6, en[3])}


def test_two_runs_over_the_same_tables(spark, tables):
    first, second = corpus_pipeline.run(spark, tables), corpus_pipeline.run(spark, tables)
    rows = lambda df: sorted((r["doc_id"], r["piece"], r["start"]) for r in df.collect())
    assert rows(second) == rows(first)
