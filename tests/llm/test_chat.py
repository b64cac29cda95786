import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.llm import chat

SCHEMA = "conv_id long, node long, parent long, role string, text string, score double"


def test_best_branch_of_a_tree(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 2.0), (1, 4, 2, "user", "c", 5.0), (1, 5, 3, "user", "d", 1.0), (1, 6, 99, "user", "lost parent", 0.5), (2, 1, 2, "user", "loop", 0.0), (2, 2, 1, "user", "loop", 0.0)]
    m = spark.createDataFrame(rows, SCHEMA)
    got = {(r["rank"], r["depth"]): r["node"] for r in chat.paths(m.select("conv_id", "node", "parent", "score"), None).collect()}
    assert got == {(1, 0): 1, (1, 1): 2, (1, 2): 4, (2, 0): 1, (2, 1): 3, (2, 2): 5, (3, 0): 6}
    best = chat.parsed(chat.formatted(m)).collect()
    assert [[(t["role"], t["text"]) for t in r["turns"]] for r in best] == [[("user", "q"), ("assistant", "a"), ("user", "c")]]
    assert best[0]["loss_text"] == "a"


@settings(max_examples=6, deadline=None)
@given(turns=st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|>\\g", None]), st.one_of(st.none(), st.text(st.sampled_from(list("\\<>bl/turn: é\n日😀")), max_size=12))), min_size=1, max_size=6))
def test_round_trip(spark, turns):
    rows = [(7, i, r, t) for i, (r, t) in enumerate([*turns, ("assistant", chat.HARD)])]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (r,) = chat.parsed(chat.formatted(chat.chained(c))).collect()
    assert [(t["role"], t["text"]) for t in r["turns"]] == [(r or "", t or "") for _, _, r, t in rows]
    assert r["loss_text"] == "".join(t or "" for _, _, r, t in rows if r == "assistant")


def test_query(spark, tables):
    got = {r["conv_id"]: r for r in chat.op9_chat_formatting(spark, tables).collect()}
    hard = f"user\n{chat.HARD}\nassistant\n{chat.HARD}\n"
    assert got[-7]["turns_sha256"] == hashlib.sha256(hard.encode()).hexdigest() and got[-7]["loss_chars"] == len(chat.HARD)
    long = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", "x" * 3000) for i in range(700)] + [(1, 5, "user", "again"), (None, 0, "user", None)], "conv_id long, turn long, role string, text string")
    out = {r["conv_id"]: len(r["turns"]) for r in chat.parsed(chat.formatted(chat.chained(long))).collect()}
    assert sorted(out.values()) == [1, 701]
    assert chat.formatted(chat.chained(long.where(F.lit(False)))).count() == 0


def test_any_id_stands_apart_from_null(spark):
    rows = [(-(1 << 62), 0, "user", "a"), (None, 0, "user", "b"), (-(1 << 63), 0, "user", "c")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.parsed(chat.formatted(chat.chained(c))).collect()
    assert sorted((r["conv_id"], r["turns"][0]["text"]) for r in out) == [(str(-(1 << 62)), "a"), (str(-(1 << 63)), "c"), (chat.NO_ID, "b")]
