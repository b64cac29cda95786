"""Edits that find their place although quotes, dashes and blanks differ."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions.edits import alike, applied_edits, edited


def test_kinds():
    assert edited("a\nb c\nd", [("b c", "x")]) == ("a\nx\nd", None, [2])
    assert edited("keep “this”  \nsay “hi” – now  \nend ", [('say "hi" - now', "done")]) == ("keep “this”  \ndone\nend ", None, [2])
    assert edited("one  \ntwo “q”\nthree  ", [('one\ntwo "q"', "x\ny\nz")]) == ("x\ny\nz\nthree  ", None, [1])
    assert edited("‘a’ x\nb  \n‘c’ z", [("'a'", "A"), ("'c'", "C")]) == ("A x\nb  \nC z", None, [1, 3])
    assert edited("a “b” c “d”", [('"b"', "1"), ('"d"', "2")]) == ("a 1 c 2", None, [1, 1])
    assert edited("x ‘a’  \ny  \nz  ", [("'a'\n", "A ")]) == ("x A y  \nz  ", None, [1])


def test_problems():
    assert edited("a", [("", "x")])[1] == "empty" and edited("a", [("b", "x")])[1] == "not found" and edited("a a", [("a", "x")])[1] == "several" and edited("‘a’ 'a'", [("'a'", "x")])[1] == "several"
    assert edited("abc", [("ab", "x"), ("bc", "y")])[1] == "overlap" and edited("a", [("a", "a")])[1] == "no change" and edited("ab", [(" \n", "x")])[1] == "not found"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a “b”", "x  ", "‘q’ – r", "plain", "", "ﬁn é"]), min_size=1, max_size=7), st.integers(0, 6), st.sampled_from(["", "new", "new\nlines"]))
def test_other_lines_stay_as_they_are(lines, at, new):
    at = at % len(lines)
    content, old = "\n".join(lines), alike(lines[at])
    made, problem, where = edited(content, [(old, new)])
    if problem is None:
        k = where[0] - 1
        assert made.split("\n")[:k] == lines[:k] and (made.split("\n")[len(made.split("\n")) - (len(lines) - k - 1) :] if k < len(lines) - 1 else []) == lines[k + 1 :]
    else:
        assert problem in ("empty", "several", "no change") and made is None


def test_column(spark):
    rows = spark.createDataFrame([(1, "say “hi”"), (2, None), (3, "x")], "i int, t string")
    got = {r["i"]: r["e"] for r in rows.select("i", applied_edits("t", F.array(F.struct(F.lit('"hi"').alias("old"), F.lit("yo").alias("new")))).alias("e")).collect()}
    assert (got[1]["content"], got[1]["problem"], got[1]["lines"]) == ("say yo", None, [1]) and got[2] is None and got[3]["problem"] == "not found"
