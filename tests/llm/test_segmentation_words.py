import numpy as np
import pyarrow as pa
from test_segmentation import every

from tallyforge.llm import segmentation as S
from tallyforge.llm import tokens

PATH = tokens.vocabulary(S.MODEL)


def words(pieces, texts):
    found, counts = pieces.cut(S.blanked(pa.array(texts, pa.string())))
    assert found.validate(full=True) is None and len(found) == counts.sum()
    found = found.to_pylist()
    return [found[b - n : b] for n, b in zip(counts.tolist(), np.cumsum(counts).tolist(), strict=True)]


def test_words_end_where_letters_do():
    pieces = S.lattices(PATH).pieces
    texts = ["the cat,\nthe 2nd cat", None, "", " ", "a  b", "été.x▁y", "日本 z", "the cat,"]
    got = words(pieces, texts)
    assert got == [[" the", " cat", ",\n", "the", " 2", "nd", " cat"], [], [], ["  "], [" a", "  b"], [" été", ".", "x", " y"], [" 日本", " z"], [" the", " cat", ","]]
    assert words(pieces, []) == []
    sliced = S.blanked(pa.array(texts, pa.string())).slice(4, 3)
    assert pieces.cut(sliced)[0].to_pylist() == [" a", "  b", " été", ".", "x", " y", " 日本", " z"]


def test_lattices_are_shared_by_words_with_other_ends():
    lat = S.Lattices(S.Pieces(PATH))
    S.sample(lat, [1, 2, 3], ["the cat", "the, cat.", "the!\ncat"], 2)
    assert set(lat.at) == {" the", " cat", ",", ".", "!\n", "cat"}


def test_every_segmentation_of_whole_words_is_found():
    """every() takes words up to the next blank as they are."""
    lat = S.lattices(PATH)
    for text in ("a,b", "it's.", "x²."):
        want = every(lat.pieces, text)
        got = {tuple(r[0].tolist()): r[1] for r in S.sample(lat, [1], [text], 2000)[0]}
        assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-4 for i in want)


def test_a_model_with_pieces_over_the_ends_of_letters_is_cut_at_blanks(monkeypatch):
    kinds = S._KIND.copy()
    kinds[ord("e")] = 2  # so that pieces cross
    monkeypatch.setattr(S, "_KIND", kinds)
    assert words(S.Pieces(PATH), ["the, cat", "x"]) == [[" the,", " cat"], [" x"]]


def test_orders_are_those_of_a_stable_sort():
    r = np.random.default_rng(4)
    head, length = r.integers(0, 50, 400), np.arange(400) % 16 + 1
    value = -r.integers(-3, 1, 400).astype(float)
    assert (S.ordered(head * 400 + np.arange(400) // 16, length) == np.lexsort((length, head * 400 + np.arange(400) // 16))).all()
    head = np.arange(400) // 16
    assert (S.ordered(head, value, length) == np.lexsort((length, value, head))).all()
    assert (S.ordered(head, value, length + 40) == np.lexsort((length, value, head))).all()
