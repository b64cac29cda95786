"""g1 joins copies of any length, against union-find."""

import pyarrow.parquet as pq

from tallyforge.plans import groups

SF = "/root/testdata/sf0.01"


def test_short_documents_have_components(spark):
    docs = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text", "source", "n_chars"]).to_pylist()
    parent = {r["doc_id"]: r["doc_id"] for r in docs}

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    first = {}
    for r in docs:
        for key in (r["text"], (r["source"], r["n_chars"])):
            a, b = root(first.setdefault(key, r["doc_id"])), root(r["doc_id"])
            parent[max(a, b)] = min(a, b)
    got = groups.g1(spark, SF).collect()
    assert any(r["n_chars"] <= 400 for r in docs)
    assert len(got) == len(docs) and {r["doc_id"]: r["component"] for r in got} == {k: root(k) for k in parent}
