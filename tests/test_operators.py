"""Operators against plain versions: searches, selections, samples, contexts, commits, views."""

import hashlib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.operators import contexts, deltas, models, similarity
from tallyforge.plans import commands, groups, reports
from tallyforge.sources import commits

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("block_bytes", [32_000_000, 200])
def test_texts_of_any_length_are_found(spark, block_bytes):
    docs = ["has short bench inside", "é x", "no", "", None, "a" * 3000 + "needle-" + "b" * 50, "aXb"]
    held = ["short bench", "é", "needle-" + "b" * 30, "zz", "X", None, "short bench", *[f"w{i}" for i in range(20)], "a" * 30 + "Q"]
    d = spark.createDataFrame(list(enumerate(docs)), "k long, t string")
    b = spark.createDataFrame([(h,) for h in held], "h string")
    want = {i for i, t in enumerate(docs) if t is not None and any(h in t for h in held if h is not None)}
    assert {r["k"] for r in similarity.containing(d, "k", "t", b, "h", block_bytes).collect()} == want == {0, 1, 5, 6}
    empty = spark.createDataFrame([("",)], "h string")
    assert {r["k"] for r in similarity.containing(d, "k", "t", empty, "h").collect()} == {0, 1, 2, 3, 5, 6}
    assert similarity.containing(d, "k", "t", b.limit(0), "h").count() == 0
    lengths = [(n, "x" * (n - 1) + "y") for n in range(1, 31)]
    found = similarity.containing(spark.createDataFrame([(n, "pad " + t + " pad") for n, t in lengths], "k long, t string"), "k", "t", spark.createDataFrame([(t,) for _, t in lengths[9:]], "h string"), "h")
    assert {r["k"] for r in found.collect()} == set(range(10, 31))


def test_forward_selection_equals_plain_loops(spark):
    rows = [(i, "ab"[i % 2], "xyz"[i % 3], i % 5, int((i * 7919 % 11 < 5) ^ (i % 2))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, f string, g string, fold long, y int")

    def loss(names):
        total = 0.0
        for r in rows:
            rest = [s for s in rows if s[3] != r[3]]
            prior = sum(s[4] for s in rest) / len(rest)
            cell = [s[4] for s in rest if all(s[n] == r[n] for n in names)]
            p = min(max((sum(cell) + 5 * prior) / (len(cell) + 5), 1e-6), 1 - 1e-6)
            total -= r[4] * math.log(p) + (1 - r[4]) * math.log(1 - p)
        return total / len(rows)

    got = models.forward_selection(df, ["f", "g"], "y", "fold", models.cells_out_of_fold)
    base, one = loss([]), {n: loss([i]) for n, i in (("f", 1), ("g", 2))}
    first = min(one, key=one.get)
    assert base - one[first] >= 0.0005 and got[0][0] == first and abs(got[0][1] - one[first]) < 1e-9
    both = loss([1, 2])
    assert len(got) == (2 if one[first] - both >= 0.0005 else 1)
    assert reports.m7(spark, SF).columns == ["step", "feature", "loss"]


def test_whole_families_meet_a_target_exactly_or_raise(spark):
    rows = spark.createDataFrame([(i, "abcc"[i % 4]) for i in range(40)], "id long, fam string")
    order = sorted("abc", key=lambda f: hashlib.sha256(f"7:{f}".encode()).hexdigest())
    sizes, taken, total = {"a": 10, "b": 10, "c": 20}, set(), 0
    for f in order:
        if total + sizes[f] <= 30:
            taken.add(f)
            total += sizes[f]
    assert {r["fam"] for r in groups.sampled_families(rows, "fam", 30, "7", exact=total == 30).collect()} == taken
    with pytest.raises(ValueError, match="not the target"):
        groups.sampled_families(rows, "fam", 33, "7", exact=True)


def test_results_follow_their_calls(spark):
    rows = [(1, 1, "user", None, None), (1, 2, "assistant", ["x", "y"], None), (1, 3, "result", None, "y"), (1, 4, "user", None, None), (1, 5, "result", None, "y"), (1, 6, "result", None, "zzz"), (1, 7, "assistant", [], None), (1, 8, "result", None, "x")]
    df = spark.createDataFrame(rows, "s long, id long, kind string, calls array<string>, answers string")
    got = [(r["shown"], r["kind"]) for r in contexts.ordered_results(df, "s").orderBy("place").collect()]
    assert got == [(1, "user"), (2, "assistant"), (None, "missing"), (3, "result"), (4, "user"), (7, "assistant")]


def test_compaction_keeps_what_it_names(spark):
    def seen(rows):
        df = spark.createDataFrame([(1, i + 1, c is not None, c, s) for i, (c, s) in enumerate(rows)], "s long, i long, compacts boolean, keep_from long, system boolean")
        return [r["i"] for r in contexts.context_entries(df, "s").orderBy("place").collect()]

    assert seen([(None, False)] * 3) == [1, 2, 3]
    assert seen([(None, False), (None, True), (None, False), (2, False), (None, True)]) == [4, 3, 5]
    assert seen([(None, False), (1, False), (None, False), (2, False), (None, False)]) == [4, 2, 3, 5]
    assert seen([(None, False), (None, False), (-3, False), (None, False)]) == [3, 4]


def test_unmarked_commits_stay_invisible(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "x long")
    commits.publish(df, str(tmp_path / "log"), 0)
    commits.publish(df, str(tmp_path / "log"), 1, marked=False)
    assert {(r["seq"], r["confirmed"]) for r in commits.state(spark, str(tmp_path / "log")).collect()} == {(0, True), (1, False)}
    assert commits.confirmed(spark, str(tmp_path / "log"), "x long").count() == 2
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        commits.publish(df, str(tmp_path / "log"), 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=9), st.lists(st.integers(0, 6), max_size=9))
def test_list_differences_are_never_longer_than_the_list(old, new):
    import json

    ops = deltas.diff({"l": old}, {"l": new})
    assert deltas.apply({"l": list(old)}, json.loads(json.dumps(ops))) == {"l": new}
    assert len(json.dumps(ops)) <= len(json.dumps([["r", {"l": new}]])) + 8


def test_sequence_ratios_stay_in_range(spark):
    assert commands.x3(spark, SF).where("ratio is null or ratio < 0 or ratio > 1").count() == 0


def test_pair_measures_of_a_few_pairs(spark):
    from tallyforge.operators import pairing

    rows = [("x", True, True, 100.0, 50.0, 4.0, 0.0), ("y", True, False, 100.0, 300.0, None, 2.0), ("z", False, True, 100.0, 80.0, 5.0, 10.0)]
    pairs = spark.createDataFrame(rows, "block string, base_ok boolean, arm_ok boolean, base_wall double, arm_wall double, base_model double, arm_model double")
    m = {r["block"]: r for r in pairing.pair_measures(pairs, "ok", {"wall": "wall", "model": "model"}).collect()}
    assert [m[b]["only_base_passes"] for b in "xyz"] == [0, 1, 0] and [m[b]["both_pass"] for b in "xyz"] == [1, 0, 0]
    assert abs(m["x"]["both_passed_wall_log"] - math.log(0.5)) < 1e-12 and m["y"]["both_passed_wall_log"] is None and m["z"]["baseline_passed_wall_base"] == 0.0
    assert [m[b]["model_unusable"] for b in "xyz"] == [1, 0, 0] and [m[b]["all_model_n"] for b in "xyz"] == [1, 0, 1] and m["x"]["all_model_log"] is None
    s = pairing.summed_measures(pairing.pair_measures(pairs, "ok", {"wall": "wall", "model": "model"}), [], "ok", {"wall": "wall", "model": "model"}).first()
    assert (s["pairs"], s["all_wall_base"], s["all_wall_arm"], s["wall_arm_list"]) == (3, 300.0, 430.0, [50.0, 80.0, 300.0]) and s["all_model_log"] == [math.log(2.0)]
