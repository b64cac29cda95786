import random
import zlib

import numpy as np

from tallyforge.llm import toxicity


def made(n=260, seed=1):
    r = random.Random(seed)
    plain = [f"{a}{b}" for a in ("sto", "riv", "hou", "gar", "lam") for b in ("ne", "er", "se", "den", "pa", "li")]
    bad = ["grumbo", "snarfle", "blighter"]
    rows, labels = [], []
    for i in range(n):
        words = r.choices(plain, k=r.choice([8, 60, 200]))
        y = int(r.random() < 0.3)
        for _ in range(y * 3):
            words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, y))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark, docs):
    rows, labels = made()
    odd = [(900, None), (901, ""), (902, "!! --"), (903, ("stone river " * 9000) + "snarfle grumbo blighter"), (None, "grumbo"), (5, rows[5][1])]
    frame = docs([*rows, *odd]).withColumnRenamed("source", "score")
    lab = spark.createDataFrame([*labels, (900, 1, None)], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    model = toxicity.fit(frame, lab, toxicity.learnable(F.col("doc_id")))
    out, (score, predicted) = toxicity.score(frame, model)
    assert score == "_score" and out.count() == len(rows) + len(odd)
    got = {r["doc_id"]: r for r in out.collect()}
    held = [(i, y) for i, _, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i][predicted] == y for i, y in held]) > 0.95
    assert all(got[i][score] == 0 for i in (900, 901, 902)) and got[903][predicted] == 1
    kept = {r["doc_id"] for r in toxicity.clean(docs(rows), lab).collect()}
    assert len(kept & {i for i, _, y in labels if not y}) > 0.97 * sum(not y for _, _, y in labels)


def test_nothing_to_learn(spark, docs):
    assert toxicity.train([], []) == 0.0 and toxicity.train(["a b"], [1]) == 1.0
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.clean(docs([(1, "text")]), lab).count() == 1
    assert toxicity.clean(docs([]), lab).count() == 0


def test_windows_cover():
    for n in (0, 1, 47, 48, 49, 80, 81, 500):
        w = toxicity.windows(n)
        assert {k for s, e in w for k in range(s, e)} == set(range(n))


def test_gradient_against_differences():
    net = toxicity.Network(3)
    each, g = toxicity.numbered(["one two three four", "five two one", "six"])
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    odds = (np.zeros(toxicity.BUCKETS), np.zeros(toxicity.BUCKETS))
    ids = toxicity.grid(each, [(0, 0, 4), (1, 0, 3), (2, 0, 1)])
    y, w = np.array([1, 0, 1]), np.array([0.5, 0.3, 0.2])
    loss = lambda: net.gradient(g, net.inputs(g, odds), ids, y, w)[1]
    d, _ = net.gradient(g, net.inputs(g, odds), ids, y, w)
    r = np.random.default_rng(0)
    for name in ("w", "u", "b", "wa", "va", "out", "bias", "words"):
        p = net.p[name]
        big = np.argsort(-np.abs(d[name]).ravel())[:3]
        for k in [*big, r.integers(p.size)]:
            at = np.unravel_index(k, p.shape)
            old, eps = p[at], 1e-3
            p[at] = old + eps
            up = loss()
            p[at] = old - eps
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * eps) - d[name][at]) < 2e-3 + 0.05 * abs(d[name][at]), name


def test_huge_text_is_skipped(spark, docs, monkeypatch):
    """A text over the bound leaves no other out, whatever its place in hash order."""
    from pyspark.sql import functions as F

    seen = []
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 2_000)
    monkeypatch.setattr(toxicity, "train", lambda texts, ys: seen.append(sorted(zip(texts, ys))) or 0.5)
    rows = [(i, f"text {i}") for i in range(40)]
    first = min(range(40), key=lambda i: spark.range(i, i + 1).select(F.xxhash64("id")).first()[0])
    rows[first] = (first, "é" * 1_001)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    toxicity.fit(docs(rows), labels, F.lit(True))
    assert seen == [sorted((t, i % 2) for i, t in rows if i != first)]


def test_scores_equal_plain_loops(spark, docs):
    """The score of a text recomputed window by window, word by word, gate by gate."""
    import re

    import numpy as np

    from tallyforge.llm import toxicity as X

    r = np.random.default_rng(11)
    plain, bad = [f"w{i}" for i in range(60)], [f"vile{i}" for i in range(6)]
    texts, labels = [], []
    for i in range(160):
        ws = r.choice(plain, int(r.integers(3, 130))).tolist()
        if i % 4 == 0:
            ws.insert(int(r.integers(0, len(ws))), str(r.choice(bad)))
        texts.append(" ".join(ws))
        labels.append(int(i % 4 == 0))
    net = X.train(texts, labels)
    assert isinstance(net, X.Network)
    sig = lambda x: 1 / (1 + np.exp(-x))

    def features(word):
        g = X.Grams([word])
        w, c = net.odds
        return np.concatenate([[w[g.word[0]], np.mean(c[g.gram]), np.max(c[g.gram])], net.p["words"][g.word[0]], net.p["grams"][g.gram].mean(0)])

    def window(words):
        x, H, states = [features(w) for w in words], X.HIDDEN, []
        for d, order in ((0, range(len(x))), (1, range(len(x) - 1, -1, -1))):
            h, own = np.zeros(H), [None] * len(x)
            for t in order:
                a, u = x[t] @ net.p["w"][d] + net.p["b"][d][0], h @ net.p["u"][d]
                z, s = sig(a[:H] + u[:H]), sig(a[H : 2 * H] + u[H : 2 * H])
                h = h + z * (np.tanh(a[2 * H :] + s * u[2 * H :]) - h)
                own[t] = h
            states.append(own)
        both = [np.concatenate(p) for p in zip(*states)]
        weight = np.exp([np.tanh(b @ net.p["wa"]) @ net.p["va"] for b in both])
        return sum(w * b for w, b in zip(weight / weight.sum(), both)) @ net.p["out"] + net.p["bias"][0]

    frame = docs([(i, t) for i, t in enumerate(texts[:24])] + [(900, None), (901, "?!"), (902, " ".join(texts[:9]))])
    got = {row["doc_id"]: row for row in X.score(frame, net)[0].collect()}
    for row in frame.collect():
        words = re.findall(r"\w+", (row["text"] or "").lower())
        cuts = [words[s : s + X.WINDOW] for s in range(0, max(len(words) - (X.WINDOW - X.STRIDE), 1), X.STRIDE)] if words else []
        want = sig(max(window(c) for c in cuts)) if cuts else 0.0
        assert abs(got[row["doc_id"]]["score"] - want) < 1e-4, row["doc_id"]
        assert got[row["doc_id"]]["predicted"] == int(got[row["doc_id"]]["score"] >= 0.5)
