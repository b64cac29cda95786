import pyarrow as pa

from tallyforge.llm import store, tokens

PATH = tokens.vocabulary(store.VOCABULARY)


def encoded(sizes):
    texts = [f"shared words with {i % 7} tails, and word{i}" for i in range(30)] + [None, ""]
    batches, at = [], 0
    for n in sizes:
        batches.append(pa.record_batch([pa.array(range(at, at + n), pa.int64()), pa.array(texts[at : at + n], pa.string())], names=["doc_id", "text"]))
        at += n
    assert at == len(texts)
    return [r for b in store._encoder(PATH, False)(iter(batches)) for r in b.to_pylist()]


def test_pieces_of_many_batches_are_looked_up_once(monkeypatch):
    monkeypatch.setattr(tokens, "_MEMOS", {})
    memo, asked = tokens.memo(PATH, False), []
    plain = memo._bases
    monkeypatch.setattr(memo, "_bases", lambda bases: asked.append(bases.to_pylist()) or plain(bases))
    one = encoded([32])
    n = len(asked[0])
    asked.clear()
    assert encoded([8, 8, 0, 16]) == one
    assert len(asked) == 1 and len(asked[0]) == n
    monkeypatch.setattr(store, "GATHERED", 1)  # a lot per batch changes no row
    assert encoded([8, 8, 0, 16]) == one


def test_a_full_memo_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "_MEMOS", {})
    want = encoded([32])
    monkeypatch.setattr(tokens, "_MEMOS", {PATH: tokens.PieceMemo(PATH, False, 4)})
    monkeypatch.setattr(store, "GATHERED", 1)
    assert encoded([4] * 8) == want
    assert tokens._MEMOS[PATH].older
