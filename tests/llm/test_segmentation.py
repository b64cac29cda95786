import math
from collections import Counter

import numpy as np
import sentencepiece

from tallyforge.llm import segmentation as S
from tallyforge.llm import tokens

PATH = tokens.vocabulary(S.MODEL)


def every(pieces, text):
    out = []

    def rec(ws, i, pos, ids, lp):
        if i == len(ws):
            out.append((tuple(ids), lp))
        elif pos == len(ws[i]):
            rec(ws, i + 1, 0, ids, lp)
        else:
            for a, b, own, x in zip(*[y.tolist() for y in pieces.edges([ws[i]])], strict=True):
                if a == pos:
                    rec(ws, i, b, ids + ([own] if own >= 0 else [pieces.bytes[q] for q in chr(-1 - own).encode()]), lp + x)

    rec(S._WORD.findall(S.normalised(text)), 0, 0, [], 0.0)
    total = np.logaddexp.reduce([x for _, x in out])
    return {ids: x - total for ids, x in out}


def test_samples_follow_the_distribution_without_replacement():
    lat = S.lattices(PATH)
    all_ = every(lat.pieces, "the cat")
    n, first, pair = 6000, Counter(), Counter()
    for rows in S.sample(lat, [S.row_key(i, 5) for i in range(n)], ["the cat"] * n, 3):
        ids = [tuple(r[0].tolist()) for r in rows]
        assert len(set(ids)) == 3 and all(abs(all_[i] - r[1]) < 1e-4 for i, r in zip(ids, rows, strict=True))
        assert rows[0][2] >= rows[1][2] >= rows[2][2] and all(0 < r[3] <= 1 for r in rows)
        first[ids[0]] += 1
        pair[ids[0], ids[1]] += 1
    top = sorted(all_, key=lambda a: -all_[a])[:3]
    for a in top:
        p = math.exp(all_[a])
        assert abs(first[a] / n - p) < 5 * math.sqrt(p * (1 - p) / n)
        for b in top:
            if a != b:
                q = p * math.exp(all_[b]) / (1 - p)
                assert abs(pair[a, b] / n - q) < 5 * math.sqrt(q * (1 - q) / n)


def test_all_segmentations_when_few():
    lat = S.lattices(PATH)
    for text in ("a", "ab", "a b"):
        got = S.sample(lat, [1], [text], 500)[0]
        assert {tuple(r[0].tolist()) for r in got} == set(every(lat.pieces, text)) and all(r[3] == 1 for r in got)
    assert [len(x) for x in S.sample(lat, [1, 2], ["", None], 4)] == [1, 1]


def test_encode_and_decode(spark, docs):
    rows = [(1, "Hello  wörld\n x\t y "), (2, None), (3, "日本語 😀￦"), (4, "z" * 20_000), (5, "to be or not " * 3000), (None, "x▁y"), (1, "Hello  wörld\n x\t y ")]
    frame = docs(rows).withColumnRenamed("source", "sample")
    out = S.encoded(frame, k=3)
    got = out.collect()
    assert all(r["round_trip"] for r in got)
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for r in got:
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        if r["doc_id"] is not None:
            assert library.decode(ids) == (dict(rows)[r["doc_id"]] or "")
    again = {(r["sample"], bytes(r["ids"])) for r in got if r["doc_id"] == 1}
    assert len(again) == 3  # repeated rows draw alike
    texts = {(r["doc_id"], r["text"]) for r in S.decoded(out).collect()}
    assert texts == {(i, (t or "").replace("▁", " ")) for i, t in rows}
    assert S.encoded(docs([])).count() == 0
