from tallyforge.llm import urls

PAGES = [
    (1, "http://a.example.com/en/7x?q#f", None),
    (2, "HTTP://EXAMPLE.NET/de/8", ""),
    (3, "https://spam.org/es/1", '<link rel="canonical" href="http://mirror.info/a/">'),
    (4, "http://mirror.info/a/?x", '<meta http-equiv="refresh" content="0; url=/b/c">'),
    (5, "http://mirror.info/b/c", "<link href='rel.html' rel='canonical'>"),
    (6, "http://mirror.info/b/rel.html", None),
    (7, None, "<p>"),
    (8, "no scheme", "<p>"),
    (9, "http://other.info", None),
    (9, "http://other.info", None),
    (10, "x://notcom/en/", None),
    (11, "http://example.com/en/79", '<link rel="canonical" href="//spam.org/es/2">'),
    (12, "http://free.info/z", '<link rel="canonical" href="http://spam.org/es/2">'),
    (13, "http://É.COM/en/?", None),
]


def frame(spark, rows=PAGES):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_rules_and_aliases(spark):
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.verdicts(frame(spark)).collect()}
    assert got[1] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[2] == ("example.net", "/de/8", "example.net/de/8", "block")
    assert got[3] == ("spam.org", "/es/1", "org/es/", "block")
    assert [got[i][3] for i in (4, 5, 6)] == ["block"] * 3 and got[4][2] is None
    assert got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow")
    assert got[9] == ("other.info", "", None, "allow") and got[10][2] is None
    # an allow anywhere in the component wins over a block for addresses without a rule
    assert got[11][3] == "allow" and got[12] == ("free.info", "/z", None, "allow")
    assert got[13] == ("É.com", "/en/", "com/en/", "block")
    assert urls.verdicts(frame(spark)).count() == len(PAGES)
    assert urls.verdicts(frame(spark, [])).count() == 0


def test_joined_rules_equal_inline_rules(spark):
    rules = spark.createDataFrame(list(urls.RULES), "rule_host string, rule_path string, action string")
    a = {tuple(r) for r in urls.verdicts(frame(spark)).collect()}
    assert a == {tuple(r) for r in urls.verdicts(frame(spark), rules).collect()}


def test_long_chain_of_redirects(spark):
    edges = spark.createDataFrame([(f"h{i}.info/", f"h{i + 1}.info/") for i in range(60)] + [("h60.info/", "spam.org/es/")], "a string, b string")
    pages = frame(spark, [(i, f"http://h{i}.info/", None) for i in range(0, 61, 20)])
    assert {r["verdict"] for r in urls.verdicts(pages, edges=edges).collect()} == {"block"}


def test_columns_of_the_caller_stay(spark):
    rows = spark.createDataFrame([("a.net", "/de/1", "mine"), ("b.info", "/", None)], "host string, path string, _best string").selectExpr("*", "'too' as best")
    for rules in (urls.RULES, spark.createDataFrame(list(urls.RULES), "rule_host string, rule_path string, action string")):
        got = sorted(tuple(r) for r in urls.judged(rows, rules).select("host", "_best", "best", "rule", "action").collect())
        assert got == [("a.net", "mine", "too", "net/de/", "allow"), ("b.info", None, "too", None, None)]
