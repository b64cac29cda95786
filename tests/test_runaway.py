"""Runaway texts: any split into chunks cuts where the definition says."""

from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions import text as T
from tallyforge.streaming.runaway import Limits, Scan, find, runaways

SMALL = Limits(least=30, tail=24, low=2, high=6, window=6, repeats=3, shortest=4)


def plain(text, w=SMALL):
    """The definition, prefix by prefix."""
    for n in range(w.least, len(text) + 1):
        t = text[:n]
        for p in range(w.low, w.high + 1):
            end = t[-w.tail :]
            if n >= w.tail and end[p:] == end[:-p]:
                return ("repeated piece", n, t[-p:], w.tail // p)
        lines = [x.strip() for x in t.split("\n")[:-1]][-w.window :]
        most = max(Counter(x for x in lines if len(x) >= w.shortest).values(), default=0)
        if most >= w.repeats:
            return ("repeated line", n, "", most)
    return None


TEXTS = st.lists(st.sampled_from(["ab", "abc", "line one\n", "line one  \n", " line two\n", "x\n", "\n", "q", "é日", "the end of it ", "}\n", "zz"]), max_size=40).map("".join)


@settings(max_examples=400, deadline=None)
@given(TEXTS, st.lists(st.integers(1, 9), min_size=1, max_size=60))
def test_any_split_cuts_where_the_whole_text_does(text, sizes):
    want = plain(text)
    assert find(text, SMALL) == want
    scan, at, got = Scan(), 0, None
    for i in range(len(text) + 1):
        chunk = text[at : at + sizes[i % len(sizes)]]
        if not chunk or (got := scan.add(chunk, SMALL)):
            break
        at += len(chunk)
        scan = Scan.of(scan.to_json())
    assert got == want


def test_state_has_a_fixed_size():
    scan, sizes = Scan(), []
    for i in range(300):
        scan.add(f"word{i} " * 900 + ("\n" if i % 50 == 49 else ""), Limits())
        sizes.append(len(scan.to_json()))
    assert max(sizes) < 4_000 and scan.seen > 1_000_000


def test_known_texts():
    assert find("x" * 25_000) == ("repeated piece", 20_000, "x" * 20, 20)
    assert find("Wait, let me check again. " * 900)[:2] == ("repeated piece", 20_000)
    start = "".join(f"line {i} of many lines\n" for i in range(1500))
    assert find(start) is None and find(start + "}\n" * 8 + "a") is None
    loop = "".join(f"the same long line here\nother {i} and words\n" for i in range(20))
    assert find(start + loop) == ("repeated line", len(start) + len(loop[: loop.index("other 7")]), "", 8)
    assert find("".join(f"the same long line here\n{i}\n" for i in range(30))) is None


def test_batch_expression_agrees(spark):
    start = "".join(f"line {i} of many lines\n" for i in range(1500))
    texts = [start, start + "the same long line here\nx\n" * 8, start + "the same long line here\nx\n" * 7 + "the same long line here", start + "}\n" * 9, start + "Wait, let me check again. " * 30, "ab" * 300]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["r"] for r in frame.select("i", T.runaway(F.col("t")).alias("r")).collect()}
    # the expression looks at the whole text only, the scan at every prefix
    assert got == {0: False, 1: True, 2: False, 3: False, 4: True, 5: False} and [find(t) is not None for t in texts] == [False, True, False, False, True, False]


def test_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    texts = {"a": "line one\n" * 9 + "and so on", "b": "nothing to see here, move along, all is new", "c": "xyz" * 30}
    chunks = [(k, i, t[i : i + 7]) for k, t in texts.items() for i in range(0, len(t), 7)] + [("b", 999, None), ("d", 0, "")]

    def run(part):
        spark.createDataFrame(part, "key string, seq long, chunk string").write.mode("append").parquet(f"{tmp_path}/in")
        feed = spark.readStream.schema("key string, seq long, chunk string").parquet(f"{tmp_path}/in")
        runaways(feed, SMALL).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()

    for low, high in ((0, 20), (20, 48), (48, 10_000)):
        run([c for c in chunks if low <= c[1] < high])
    got = {r["key"]: (r["rule"], r["at"], r["piece"], r["times"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {k: plain(t) for k, t in texts.items() if plain(t)} and set(got) == {"a", "c"}


def test_query_equals_whole_texts(spark):
    from tallyforge.plans import streams

    sf = "/root/testdata/sf0.001"
    texts = {}
    for r in sorted(streams.streamed_texts(spark, sf).collect(), key=lambda r: r["seq"]):
        texts[r["key"]] = texts.get(r["key"], "") + r["chunk"]
    want = {k: c for k, t in texts.items() if (c := find(t, Limits(least=500)))}
    got = {r["key"]: (r["rule"], r["at"], r["piece"], r["times"]) for r in streams.t7_cut(spark, sf).collect()}
    assert got == want and {c[0] for c in want.values()} == {"repeated piece", "repeated line"}
