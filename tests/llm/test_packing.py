import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyforge.llm import packing, tokens


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 16), st.integers(1, 30), min_size=1))
def test_plan_uses_each_piece_once_and_fits(histogram):
    bins = packing.plan(histogram, 16)
    used = Counter()
    for copies, parts in bins:
        assert copies > 0 and sum(n * m for n, m in parts) <= 16
        for n, m in parts:
            used[n] += copies * m
    assert used == Counter(histogram)
    assert sum(c for c, _ in bins) >= -(-sum(n * c for n, c in histogram.items()) // 16)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=13, max_size=13), st.integers(1, 12))
def test_fullest_is_the_best_subset_sum(counts, room):
    counts[0] = 0
    best = {0}
    for n, c in enumerate(counts):
        for _ in range(c):
            best |= {x + n for x in best if x + n <= room}
    got = packing.fullest(counts, room, 12)
    assert sum(n * m for n, m in got) == max(best)
    assert all(m <= counts[n] for n, m in got)


def test_cut():
    assert packing.cut(1024) == [(0, 1024)]
    assert packing.cut(1025) == [(0, 1), (1, 1024)]
    assert packing.cut(2048) == [(0, 1024), (1024, 1024)]


def test_pack_documents(spark, docs):
    long = "word and more " * 3000
    rows = [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "c"), (5, long), (6, "x" * 50_000), *[(i, "copy") for i in range(10, 200)]]
    frame = docs(rows).withColumnRenamed("n_chars", "length")
    out = packing.pack(packing.pieces(frame, with_ids=True)).collect()
    at = {}
    for r in out:
        assert r["length"] <= 1024
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in at.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end = offset + n
        assert end <= 1024
    tok = Tokenizer.from_file(tokens.vocabulary(packing.VOCABULARY))
    whole = np.array([*tok.encode(long, add_special_tokens=False).ids, 2], "<u4").tobytes()
    mine = sorted((r for r in out if r["doc_id"] == 5), key=lambda r: r["piece"])
    assert b"".join(bytes(r["ids"]) for r in mine) == whole
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in out)
    assert sum(r["doc_id"] == 3 for r in out) == 2 and sum(r["doc_id"] is None for r in out) == 1
    total = sum(r["length"] for r in out)
    assert len(at) <= -(-total // 1024) + 2


def test_empty_table(spark, docs):
    assert packing.pack(packing.pieces(docs([]))).count() == 0


def test_piece_too_long_is_refused(spark):
    with pytest.raises(ValueError):
        packing.plan({2000: 1})


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@settings(max_examples=80, deadline=None)
@given(text=st.text(st.sampled_from(list("ab'sÉé́ \n\t\r\x0b\x1c\x85　<|>9_日ΣσE")), max_size=30))
def test_memo_equals_library(name, spaced, text):
    path = tokens.vocabulary(name)
    tok = tokens.memo(path, spaced)
    for t in (text, text + "<|endoftext|> " + text):
        assert tok.encode([t, t])[1] == np.array(tok.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_clashing_columns_stay(spark):
    rows = [(i, 100 + i, "x", 1, 2, 3, 4, 5) for i in range(30)]
    frame = spark.createDataFrame(rows + rows[:3], "doc_id long, length long, _salt string, salt long, count long, rank long, sequence_id long, offset long")
    out = packing.pack(frame)
    assert out.columns == [*frame.columns, "_sequence_id", "_offset"]
    got = out.collect()
    assert len(got) == 33 and {(r["_salt"], r["salt"], r["count"], r["rank"], r["sequence_id"], r["offset"]) for r in got} == {("x", 1, 2, 3, 4, 5)}
    assert len({(r["_sequence_id"], r["_offset"]) for r in got}) == 33
