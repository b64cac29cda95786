"""x22 reports the whole common prefix, however long."""

import os.path

from tallyforge.plans import texts


def test_prefix_beyond_199_characters(spark, tmp_path):
    start = "é boilerplate " * 400
    docs = [(1, start + "first"), (2, start + "second"), (3, start + "second"), (4, start[:250]), (5, "other")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {a[0]: len(os.path.commonprefix([a[1], b[1]])) for a, b in zip(docs, docs[1:])}
    assert want[2] == len(start) + 6
    assert {r["doc_id"]: r["prefix"] for r in texts.x22(spark, str(tmp_path)).collect()} == want
