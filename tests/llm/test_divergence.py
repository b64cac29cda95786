import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyforge.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, least=3, top=200):
    docs = [(lang or "", source or "", Counter(TERM.findall((text or "").translate(UPPER)))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in d[2])
        kept = sorted(t for t in df if df[t] >= least)
        total = Counter()
        by = {}
        for _, s, c in mine:
            by.setdefault(s, Counter()).update({t: n for t, n in c.items() if df[t] >= least})
            total.update({t: n for t, n in c.items() if df[t] >= least})
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        q, shares = p(total), {s: p(c) for s, c in by.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in by:
            pairs = [(o, sum(f(shares[s][t], shares[o][t]) for t in kept)) for o in by if o != s]
            terms = [(t, f(shares[s][t], q[t])) for t in kept if by[s][t] > 0 and shares[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:limit]):
                    out.append((lang, s, part, item, value, rank + 1))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def made(seed, n=120):
    rng = random.Random(seed)
    words = ["a", "B", "zug", "Zug", "naïve", "ÄB", "été", "x1y", "don't", "漢字", "𝔘ber", "rare%d"]
    rows = []
    for i in range(n):
        text = " ".join(w % rng.randrange(60) if "%" in w else w for w in (rng.choice(words) for _ in range(rng.randrange(0, 25))))
        rows.append((i, rng.choice([text, text, text.replace(" ", "_"), None if i % 17 == 0 else text]), rng.choice(["en", "de", None, ""]), rng.choice(["s0", "s0", "s1", "S2", None, "é"])))
    return rows


def test_equals_plain(spark):
    for seed in (1, 2):
        rows = made(seed)
        assert rows_of(divergence.divergence(spark.createDataFrame(rows, SCHEMA).repartition(5))) == plain(rows)


def test_a_tiny_sketch_and_few_held_change_nothing(spark, monkeypatch):
    """Full cells only let more terms through; a flush at every document only sends more rows."""
    monkeypatch.setattr(divergence, "BLOCK", 16)
    rows = made(3)
    frame = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(divergence.divergence(frame, top=3, width=64, depth=2)) == plain(rows, top=3)
    assert rows_of(divergence.divergence(frame, least=1)) == plain(rows, least=1)


def test_sources_in_blocks_and_shuffled_totals(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SOURCES_A_TASK", 2)
    monkeypatch.setattr(divergence, "FEW_GROUPS", 1)
    rows = made(4)
    assert rows_of(divergence.divergence(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_groups_without_terms_repeats_and_clashes(spark):
    rows = [(1, "one two", "en", "a"), (1, "one two", "en", "a"), (2, None, "en", "b"), (3, "one", "en", "c"), (4, "1 2 3", "fr", "a"), (5, None, None, None), (6, "", "", "x")]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(divergence.divergence(frame)) == plain(rows)
    assert ("fr", "a") not in {(r[0], r[1]) for r in plain(rows)}
    more = frame.withColumns({c: F.lit("z") for c in ("n", "term", "v", "p", "q", "rank", "value", "item", "leads")})
    assert rows_of(divergence.divergence(more)) == plain(rows)
    assert rows_of(divergence.divergence(frame.where("false"))) == []


def test_terms_of_texts_in_blocks(monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 4)
    text = "Ab'cd e\x00f ÄÖ_" + "long" * 10 + " 9z"
    assert [t.decode() for x in divergence.terms(text.encode()) for t in x] == TERM.findall(text.translate(UPPER))
    assert list(divergence.terms(b"")) == []


def test_sketch_never_underestimates():
    rng = random.Random(6)
    counts = Counter(f"t{rng.randrange(400)}".encode() for _ in range(900))
    sketch = np.zeros(512 * 3, np.uint8)
    for part in (list(counts)[::2], list(counts)[1::2], list(counts)[::5]):
        divergence.add(sketch, divergence.cells(b"en", part, 512, 3), np.array([counts[t] for t in part]), 3)
    estimate = sketch[divergence.cells(b"en", list(counts), 512, 3)].min(axis=0)
    assert all(e >= min(3, n) for e, n in zip(estimate.tolist(), counts.values(), strict=True))


def test_shares_beyond_a_long(spark):
    frame = spark.createDataFrame([(40_000_000_000, 90_000_000_000, 7)], "n long, total long, v long")
    assert frame.select(divergence.share("n", "total", "v").alias("p")).first()["p"] == 1 + 10**9 * 40_000_000_001 // 90_000_000_007
