import math
import random
import re
from collections import Counter

from tallyforge.llm import quality


def brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def prose(i):
    r = random.Random(i)
    return " ".join(r.choice(["the", "of", "and", "in"]) if r.random() < 0.4 else "".join(r.choices(["sto", "ri", "ver", "hou", "se", "ne"], k=3)) for _ in range(120))


def test_measures_and_verdict(spark, docs):
    odd = [(900, None), (901, ""), (902, "a b c a b c\n \na b c\n\na b c"), (903, "#*$ %&|<> é日本 word"), (904, ("one two three four five six seven " * 2000)), (904, "short"), (905, "\t\x0b x y z"), (None, prose(1))]
    junk = [(950, " ".join(f"{i}!?{i}#" for i in range(400)))]
    rows = [(i, prose(i)) for i in range(60)] + [(*x, "xx") for x in odd] + junk
    got = quality.judged(docs(rows).withColumnRenamed("source", "words")).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((r["doc_id"], tuple(r[n] for n in names)) for r in got), key=key) == sorted(((r[0], brute(r[1])) for r in rows), key=key)
    by = {r["doc_id"]: r for r in got}
    assert not by[950]["kept"] and not by[950]["base_failed"]
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert sum(by[i]["kept"] for i in range(60)) == 60
    assert quality.judged(docs([])).count() == 0


def test_distance(spark):
    from pyspark.sql import functions as F

    p, q = [0.5, 0.5, 0.0], [0.1, 0.2, 0.7]
    m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m, strict=True) if a)
    arr = lambda x: F.array(*map(F.lit, x))
    row = spark.range(1).select(quality.distance(arr(p), arr(q)).alias("d"), quality.distance(arr(p), arr(p)).alias("z"), quality.distance(arr([1.0, 0.0]), arr([0.0, 1.0])).alias("o")).first()
    assert abs(row["d"] - math.sqrt((kl(p) + kl(q)) / 2)) < 1e-12 and row["z"] == 0 and abs(row["o"] - 1) < 1e-12


def test_every_language_has_its_reference(spark, docs):
    n = quality.LANGUAGES + 20
    # the rarest languages have words of their own, which the pooled reference does not list
    rows = [(i, " ".join(f"w{i}x{j % 20}" for j in range(400 if i < n - 5 else 120)), f"l{i:03}") for i in range(n)]
    got = {r["doc_id"]: r for r in quality.judged(docs([*rows, (n, "", "none"), (n + 1, "a b", None)])).collect()}
    assert len(got) == n + 2 and all(got[i]["word_distance"] == 0 and got[i]["char_distance"] == 0 for i in range(n))


def test_letters_of_other_scripts(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(quality.classes(F.lit("Дом é A1。、"), F.lit(2)).alias("c")).first()
    assert row["c"][:5] == [3.0, 2.0, 1.0, 2.0, 2.0]


def test_distances_equal_plain_loops(spark, tables):
    """Both distances and the verdict of every document, from plain counts of whole texts."""
    import math
    import re
    from collections import Counter

    rows = [r for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "lang", "text").collect()]
    words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")

    def classes(t):
        import unicodedata

        kinds = [unicodedata.category(c) for c in t]
        letters, capitals = sum(k[0] == "L" for k in kinds), sum(k == "Lu" for k in kinds)
        digits, blanks = sum(c in "0123456789" for c in t), len(re.findall(r"[\x20\x09-\x0D]", t))
        return [letters - capitals, capitals, digits, blanks, len(t) - blanks - letters - digits, len(t.encode()) - len(t)]

    def shares(x):
        return [v / sum(x) for v in x] if sum(x) else None

    def distance(p, q):
        if p is None or q is None:
            return None
        half = lambda a, m: a * math.log2(a / m) if a > 0 else 0.0
        return math.sqrt(max(0.0, sum(half(a, (a + b) / 2) + half(b, (a + b) / 2) for a, b in zip(p, q)) / 2))

    ref = {}
    for lang in {r["lang"] for r in rows} | {"*"}:
        own = [r["text"] or "" for r in rows if lang in ("*", r["lang"])]
        counts = Counter(w for t in own for w in words_of(t))
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0].encode()))[: quality.COMMON]
        ref[lang] = ([w for w, _ in top], shares([n for _, n in top] + [sum(counts.values()) - sum(n for _, n in top)]), shares([sum(c) for c in zip(*map(classes, own))]))
    got = {r["doc_id"]: r for r in quality.op7_quality_rules(spark, tables).collect()}
    assert len(got) == len(rows)
    for r in rows:
        g, ws, (common_words, word_shares, char_shares) = got[r["doc_id"]], words_of(r["text"]), ref[r["lang"]]
        counts = Counter(ws)
        own = [counts[w] for w in common_words]
        word_d, char_d = distance(shares(own + [len(ws) - sum(own)]), word_shares), distance(shares(classes(r["text"] or "")), char_shares)
        for name, want in (("word_distance", word_d), ("char_distance", char_d)):
            assert (g[name] is None) == (want is None) and (want is None or abs(g[name] - want) < 2e-6), (r["doc_id"], name, g[name], want)
        odd = (g["word_chars"] >= quality.MIN_CHARS and char_d is not None and char_d > quality.CHAR_LIMIT) or (len(ws) >= quality.MIN_WORDS and word_d is not None and word_d > quality.WORD_LIMIT)
        assert g["kept"] == (not g["base_failed"] and not odd)


def test_a_language_called_like_the_pooled_row(spark, docs):
    rows = [(1, "some words of a text", "*"), (2, "some words of another", None), (3, "words", "=*"), (4, "words", "")]
    assert sorted(r["doc_id"] for r in quality.judged(docs(rows)).collect()) == [1, 2, 3, 4]
