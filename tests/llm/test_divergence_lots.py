from types import SimpleNamespace

import pyarrow as pa
from test_divergence import SCHEMA, made, plain, rows_of

from tallyforge.llm import divergence

NAMES = ["lang", "source", "text"]


def batch(*rows):
    return pa.record_batch([pa.array(c, pa.binary()) for c in zip(*rows, strict=True)], names=NAMES)


def word(i):
    return "".join(chr(97 + int(c)) for c in str(i))


def test_a_task_sends_a_term_of_a_group_once():
    """Also with more terms than it sends at once or than a memo would hold."""
    text = " ".join(word(i) for i in range(450_000)).encode()
    bits = SimpleNamespace(value=b"\xff" * 8)
    sent = [r for b in divergence._counted(bits, 64, 1)(iter([batch((b"en", b"a", text)), batch((b"en", b"a", text + b" ")), batch((b"en", b"b", b"b b"))])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(sent) == 450_000 + 1 + 2
    assert {(n, docs) for _, source, term, n, docs in sent if source == "a" and term} == {(2, 2)}
    assert [r for r in sent if r[1] == "b" or r[2] is None] == [("en", "b", "b", 2, 1), *[r for r in sent if r[2] is None]]
    assert sorted(r[1] for r in sent if r[2] is None) == ["a", "b"]


def test_lots_and_texts_beyond_a_lot_change_nothing(spark, monkeypatch):
    """The functions that run on workers are held to tiny lots here."""
    bits = SimpleNamespace(value=b"\xff" * 8)
    rows = [tuple((x or "").encode() for x in (lang, source, text)) for _, text, lang, source in made(5)]
    batches = [batch(*rows[i : i + 7]) for i in range(0, len(rows), 7)] + [batch(*rows).slice(0, 0)]

    def counted():
        out = {}
        for b in divergence._counted(bits, 64, 1)(iter(batches)):
            for lang, source, term, n, docs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                a = out.setdefault((lang, source, term), [0, 0])
                a[0] += n
                a[1] += docs
        return out

    def cells():
        monkeypatch.setattr(divergence, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
        return [r for b in divergence._sketched(3, 64, 2, 16, 4)(iter(batches)) for r in b.to_pylist()]

    want, sketch = counted(), cells()
    assert sum(b.num_rows for b in divergence._lots(iter(batches))) == len(rows)
    for lot in (1, 40, 200):
        monkeypatch.setattr(divergence, "LOT", lot)
        lots = list(divergence._lots(iter(batches)))
        assert len(lots) > 5 and [r for b in lots for r in b.to_pylist()] == [r for b in batches for r in b.to_pylist()]
        assert counted() == want and cells() == sketch
    monkeypatch.undo()
    rows = made(5)
    assert rows_of(divergence.divergence(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain(rows)
