import difflib
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions import python_udfs as U
from tallyforge.functions import search, stats
from tallyforge.functions import text as T
from tallyforge.operators import deltas, quantiles

VALUES = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.text("ab", max_size=4), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text("xy", min_size=1, max_size=2), x, max_size=3), max_leaves=12)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_textbook_statistics(spark):
    low, high = stats.wilson(F.lit(8), F.lit(10))
    r = one(spark, low=low, high=high, p=stats.mcnemar(F.lit(1), F.lit(9)), none=stats.mcnemar(F.lit(0), F.lit(0)), ratio=stats.ratio(F.lit(1), F.lit(0)))
    assert abs(r["low"] - 0.4902) < 1e-4 and abs(r["high"] - 0.9433) < 1e-4
    assert abs(r["p"] - 22 / 1024) < 1e-12 and r["none"] == 1 and r["ratio"] is None


def test_quantile_definitions(spark):
    x = spark.range(10).select((F.col("id") + 1).alias("x"))
    r = quantiles.quantiles(x, [], "x", {"d": ("disc", 0.9), "f": ("floor", 0.9), "c": ("cont", 0.9)}).first()
    assert (r["d"], r["f"]) == (9, 10) and abs(r["c"] - 9.1) < 1e-9
    assert abs(x.agg(stats.geomean(F.col("x"))).first()[0] - 3628800**0.1) < 1e-9


def test_quantiles_equal_numpy(spark):
    r = np.random.default_rng(5)
    rows = [(g, float(v)) for g, scale in (("a", 1e-3), ("b", 1e6), (None, 3.0)) for v in np.round(r.normal(size=257) * scale, 6)] + [("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {x["g"]: x for x in quantiles.quantiles(df, ["g"], "v", {"p5": ("cont", 0.05), "p50": ("cont", 0.5), "p99": ("cont", 0.99), "low": ("disc", 0.0), "top": ("floor", 1.0)}).collect()}
    assert set(got) == {"a", "b", None}
    for g, x in got.items():
        own = [v for k, v in rows if k == g and v is not None]
        assert np.allclose([x["p5"], x["p50"], x["p99"]], np.percentile(own, [5, 50, 99]), rtol=1e-12) and (x["low"], x["top"]) == (min(own), max(own))
    joined = quantiles.with_quantiles(df.groupBy("g").count(), df, ["g"], "v", {"m": ("cont", 0.5)}).collect()
    assert len(joined) == 4 and [x["m"] for x in joined if x["g"] == "none"] == [None] and all(x["m"] is not None for x in joined if x["g"] != "none")


def fuzzy(query, text):
    """The score, character by character."""
    query, text = query.lower(), text.lower()

    def score(q):
        at, run, s = -1, 0, 0.0
        for c in q:
            i = text.find(c, at + 1)
            if i < 0:
                return None
            if i == at + 1:
                run += 1
                s -= 5 * run
            else:
                run = 0
                s += 2 * (i - at - 1) if at >= 0 else 0
            s -= 10 if i == 0 or text[i - 1] in " \t\n-_./:" else 0
            s += 0.1 * i
            at = i
        return s - 100 * (q == text)

    return score(query)


def test_fuzzy_scores(spark):
    texts = ["session log", "log", "a_l.o/g", "lxoxg", "golf", "abc12", "12abc", "Log viewer", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["s"] for r in df.select("t", search.fuzzy_score("log", F.col("t")).alias("s")).collect()}
    for t in texts:
        want = fuzzy("log", t)
        assert got[t] is None if want is None else abs(got[t] - want) < 1e-9, t
    swapped = {r["t"]: r["s"] for r in df.select("t", search.fuzzy_score("abc12", F.col("t")).alias("s")).collect()}
    assert abs(swapped["12abc"] - (fuzzy("12abc", "12abc") + 5)) < 1e-9
    assert [r["t"] for r in search.ranked(df, "log", "t").limit(1).collect()] == ["log"]
    assert {r["t"] for r in search.ranked(df, '"log v"', "t").collect()} == {"Log viewer"}
    assert {r["t"] for r in search.ranked(df, "re:^a.*2$", "t").collect()} == {"abc12"}


def test_text_functions(spark):
    r = one(spark, grams=T.char_ngrams(F.lit("abcabc"), 3), none=T.char_ngrams(F.lit("ab"), 3), dice=T.dice(F.lit("night"), F.lit("nacht")), same=T.near_identical(F.lit("x" * 30 + "y"), F.lit("x" * 30 + "z")),
        short=T.near_identical(F.lit("ab"), F.lit("ac")), pre=T.common_prefix(F.lit("abcde"), F.lit("abXde")), mb=T.size_to_mb(F.lit("8G")), bad=T.size_to_mb(F.lit("x")), key=T.group_key(F.lit("fix_run3__e2e")),
        tests=T.test_counts(F.lit("== 2 failed, 5 passed in 3s")), ran=T.test_counts(F.lit("Ran 9 tests\nFAILED (failures=1, errors=2)")), run=T.runaway(F.lit("ab" * 20_000)), calm=T.runaway(F.lit("ab" * 20)), units=T.utf16_length(F.lit("a😀")))
    assert sorted(r["grams"]) == ["abc", "bca", "cab"] and r["none"] == [] and abs(r["dice"] - 0.25) < 1e-12
    assert r["same"] and not r["short"] and r["pre"] == 2 and r["mb"] == 8192 and r["bad"] is None and r["key"] == "fix"
    assert tuple(r["tests"]) == (5, 2) and tuple(r["ran"]) == (6, 3) and r["run"] and not r["calm"] and r["units"] == 3


def test_python_functions(spark):
    a, b = "the quick brown fox", "a quick brown cat"
    r = one(spark, ratio=U.sequence_ratio(F.lit(a), F.lit(b)), canon=U.canonical_json(F.lit('{"b": "x  y", "a": [1]}')), cut=U.repaired_json(F.lit('{"a": [1, {"b": "x')), ok=U.repaired_json(F.lit("[1,2]")), bad=U.repaired_json(F.lit("}{")),
        path=U.resolved_path(F.lit("/a/b"), F.lit("../c/./d")), over=U.overlap(F.lit("abcab"), F.lit("cabx")), diff=U.unified_diff(F.lit("a\nb"), F.lit("a\nc")))
    want = max(difflib.SequenceMatcher(None, *x).ratio() for x in ((a, b), (b, a)))
    assert abs(r["ratio"] - want) < 1e-12 and r["canon"] == '{"a":[1],"b":"x y"}'
    assert json.loads(r["cut"]) == {"a": [1, {"b": "x"}]} and json.loads(r["ok"]) == [1, 2] and r["bad"] is None
    assert r["path"] == "/a/c/d" and r["over"] == 3 and "-b" in r["diff"]


@settings(max_examples=200, deadline=None)
@given(VALUES, VALUES)
def test_diff_then_apply(old, new):
    ops = deltas.diff(old, new)
    got = deltas.apply(json.loads(json.dumps(old)), json.loads(json.dumps(ops)))
    assert json.dumps(got, sort_keys=True) == json.dumps(new, sort_keys=True)


def test_materialise(spark):
    rows = [(1, 1, "base", '{"n": "a", "l": [1, 2, 3]}'), (1, 2, "delta", '[["a", ["n"], "b"], ["p", ["l"], 1, 1, [9, 8]]]'), (1, 3, "base", '{"n": "z"}'), (1, 4, "delta", '[["s", ["k"], 1], ["d", ["n"]]]'), (2, 5, "base", "[3, 1]"), (2, 6, "delta", '[["m", [], [1, 0]]]')]
    df = spark.createDataFrame(rows, "document_id long, seq long, kind string, content string")
    now = {r["document_id"]: json.loads(r["content"]) for r in deltas.materialise(df).collect()}
    assert now == {1: {"k": 1}, 2: [1, 3]}
    then = {r["document_id"]: json.loads(r["content"]) for r in deltas.materialise(df, 2).collect()}
    assert then == {1: {"n": "ab", "l": [1, 9, 8, 3]}}
    assert deltas.violations(df).count() == 0 and deltas.violations(df.where("seq > 1")).count() == 1
    with pytest.raises(ValueError):
        deltas.apply({"a": 1}, [["a", ["a"], "x"]])
