import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import lines

BLANK = " \t\n\x0b\x0c\r"
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain(rows):
    """(doc_id, text) -> sorted (doc_id, lines, dropped, digest), line by line."""
    owners = {}
    for doc_id, text in rows:
        for x in (text or "").split("\n"):
            k = x.strip(BLANK).translate(UPPER)
            if len(k) >= 10 and doc_id is not None:
                owners[k] = min(owners.get(k, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        every = (text or "").split("\n")
        kept = [x for x in every if owners.get(x.strip(BLANK).translate(UPPER), doc_id) == doc_id]
        out.append((doc_id, len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def result(index, rows, docs):
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in index.deduplicated(docs(rows)).collect()), key=str)


ROWS = [
    (5, "A Shared Line here\nmine alone, number five\nA shared line HERE \n\nshort"), (2, "\ta shared line here\rx\n a shared line here\t"), (9, "a shared line here"), (3, None), (4, ""), (7, "short\nshort"),
    (8, "ÄÖÜ äöü ßßß\nsame\nsame"), (10, "äÖÜ äöü ßßß\nÄÖÜ äöü ßßß"), (None, "a shared line here\nonly without an id"), (None, "only without an id"), (11, "twice in one\ntwice in one"), (11, "twice in one"),
    (12, "y" * 70_000 + "\nend of a very long one"), (13, "y" * 70_000 + "\nend of a very long one"), (1, "123456789\n1234567890"), (14, "123456789\n1234567890\n"),
]


def test_equals_plain(spark, docs):
    index = lines.LineIndex(spark)
    index.insert(docs(ROWS))
    assert result(index, ROWS, docs) == plain(ROWS)
    kept = {r["doc_id"]: r["kept"] for r in index.deduplicated(docs(ROWS)).collect()}
    assert kept[9] == "" and kept[2] == "\ta shared line here\rx\n a shared line here\t" and kept[14] == "123456789\n"


def test_empty_table(spark, docs):
    index = lines.LineIndex(spark)
    index.insert(docs([]))
    assert index.deduplicated(docs([])).count() == 0 and index.counts().count() == 0


def table(index):
    return sorted((bytes(r["digest"]), r["n"], r["owner"]) for r in index.counts().collect())


def held(index, digests):
    at = lines.Cuckoo.places(digests)
    parts = [lines.Cuckoo(bytes(r["body"])) for r in index._filters().collect()]
    return [any(p.may_hold(*(x[i : i + 1] for x in at))[0] for p in parts) for i in range(len(digests))]


def test_batches_and_deletions(spark, docs):
    """Batches give what one insertion gives; a deletion gives back what was before."""
    rng = random.Random(3)
    every = [(i, "\n".join(rng.choice([f"common line number {rng.randrange(6)}", f"line of document {i} alone", "tiny"]) for _ in range(rng.randrange(1, 6)))) for i in range(40)]
    first, second = every[::2], every[1::2]
    index = lines.LineIndex(spark, shards=3)
    index.insert(docs(second))
    before = table(index)
    index.insert(docs(first))
    whole = lines.LineIndex(spark)
    whole.insert(docs(every))
    assert table(index) == table(whole)
    assert result(index, every, docs) == plain(every)
    index.delete(docs(first).select("doc_id"))
    assert table(index) == before
    assert result(index, second, docs) == plain(second)
    again = lines.LineIndex(spark, index.path, shards=3)
    again.insert(docs(first[:5]))
    assert table(again) == sorted(table(again)) and result(again, second + first[:5], docs) == plain(second + first[:5])
    present = [d for d, _, _ in table(again)]
    assert all(held(again, present))
    again.delete(docs(every).select("doc_id"))
    assert table(again) == []
    assert sum(held(again, present)) <= len(present) // 50


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 300))
def test_filter_never_forgets(seed, n):
    rng = random.Random(seed)
    keys = [rng.randbytes(16) for _ in range(n)]
    f = lines.Cuckoo()
    assert f.insert_many(keys) == []
    f = lines.Cuckoo(f.body())
    assert f.held == n and f.may_hold(*lines.Cuckoo.places(keys)).all()
    for k in keys[: n // 2]:
        assert f.remove(*[int(x[0]) for x in lines.Cuckoo.places([k])])
    assert f.held == n - n // 2
    if keys[n // 2 :]:
        assert f.may_hold(*lines.Cuckoo.places(keys[n // 2 :])).all()


def test_filter_fills_and_overflows():
    rng = random.Random(1)
    keys = [rng.randbytes(16) for _ in range(lines.FILL + 500)]
    f = lines.Cuckoo()
    left = f.insert_many(keys)
    assert 500 <= len(left) <= 600
    inside = sorted(set(keys) - set(left))
    assert f.may_hold(*lines.Cuckoo.places(inside)).all()
    one = keys[0]
    g, same = lines.Cuckoo(), [one] * 9
    assert len(g.insert_many(same)) == 1  # two buckets hold eight of a kind


def test_shards_overflow_into_parts(spark, docs, monkeypatch):
    monkeypatch.setattr(lines, "FILL", 40)
    import pyarrow as pa

    rng = random.Random(2)
    keys = sorted(rng.randbytes(16) for _ in range(100))
    rows = [pa.record_batch([pa.array([7] * 100, pa.int32()), pa.array([None] * 100, pa.int32()), pa.array(keys, pa.binary()), pa.array([None] * 100, pa.binary())], names=lines._STREAM)]
    parts = [r for b in lines._filled(iter(rows)) for r in b.to_pylist()]
    assert [(p["shard"], p["part"]) for p in parts] == [(7, 0), (7, 1), (7, 2)]
    stream = [pa.record_batch([pa.array([7] * 3, pa.int32()), pa.array([0, 1, 2], pa.int32()), pa.array([None] * 3, pa.binary()), pa.array([p["body"] for p in parts], pa.binary())], names=lines._STREAM), *rows]
    assert sorted(x for b in lines._probed(iter(stream)) for x in b.column(0).to_pylist()) == keys


def test_unfinished_changes_are_not_read(spark, docs):
    index = lines.LineIndex(spark)
    index.insert(docs([(1, "the first line of all")]))
    index._write(spark.createDataFrame([(b"x" * 16, 5, 1)], "digest binary, n long, owner long"), "counts", 1)
    assert len(table(index)) == 1
    index.insert(docs([(0, "the first line of all")]))
    assert [(n, o) for _, n, o in table(index)] == [(2, 0)]


def test_clashing_columns(spark, docs):
    from pyspark.sql import functions as F

    more = docs(ROWS[:3]).withColumns({c: F.lit("z") for c in ("digest", "of", "gone", "n", "owner", "shard", "kept")})
    index = lines.LineIndex(spark)
    index.insert(more)
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in index.deduplicated(more).collect()) == plain(ROWS[:3])


@pytest.mark.parametrize("text", ["", "\n", "a\r\n b \x0b"])
def test_keys(text):
    assert [lines.key_of(x).decode() for x in text.encode().split(b"\n")] == [x.strip(BLANK).translate(UPPER) for x in text.split("\n")]
