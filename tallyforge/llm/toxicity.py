"""Toxicity by a bidirectional gated recurrent network over overlapping windows.

Words (letters and digits, lower case) enter as a vector of word and character inputs:
smoothed log-odds of the word and of its byte n-grams (3 to 5, with both ends marked)
among toxic and other training texts, and trained hashed embeddings of both. Two gated
recurrent layers read a window of WINDOW words from either side, attention pools their
states, and a logistic unit scores the window. Windows overlap by WINDOW - STRIDE words
and cover the whole text; a text's score is that of its highest window.

Training is plain numpy on the driver, on at most SAMPLE_ROWS labelled texts in the
order of a hash of their ids. Log-odds are crossed between two halves of them, so the
network never sees a text's own label in its inputs. Of a toxic text, the window with
the largest log-odds is learnt as toxic; of other texts, that one and random ones as
not. A fifth of the sample is kept back to place the cut between the classes at 0.5.

A null or wordless text scores 0. With no labelled row, or one class only, every text
scores the share of toxic rows (0 without rows). Repeated rows score alike; extra
columns pass through; null labels are not learnt from.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLE_ROWS = 5_000
#: Most bytes of text that the training sample brings to the driver.
SAMPLE_BYTES = 60_000_000
#: Texts that training holds as numbers at one time.
CHUNK = 150
WINDOW, STRIDE = 48, 32
HIDDEN, ATTEND = 8, 8
BUCKETS, EMBED = 1 << 14, 4
GRAMS = (3, 4, 5)
PSEUDO = 12.0
EPOCHS, RATE, GROUP = 5, 0.01, 128
BLOCK = 2048
DEPTH = 3 + 2 * EMBED

_WORD = re.compile(r"\w+")


def split(texts: list[str | None]) -> tuple[list[list[str]], list[str]]:
    """Words of each text, and the distinct ones."""
    each = [_WORD.findall((t or "").lower()) for t in texts]
    return each, list(dict.fromkeys(w for ws in each for w in ws))


class Grams:
    """Hash buckets of distinct words and of their byte n-grams."""

    def __init__(self, words: list[str]):
        raw = [b"^" + w.encode("utf-8") + b"$" for w in words]
        self.word = np.array([xxhash.xxh32_intdigest(r) % BUCKETS for r in raw], np.int64)
        size = np.array([len(r) for r in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
        owner = np.repeat(np.arange(len(raw)), size)
        found, owners = [], []
        for n in GRAMS:
            m = len(data) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, np.uint32)
            for k in range(n):
                h = (h ^ data[k : k + m]) * np.uint32(0x01000193)
                h ^= h >> np.uint32(15)
            inside = owner[:m] == owner[n - 1 :]
            found.append((h[inside] % np.uint32(BUCKETS)).astype(np.int64))
            owners.append(owner[:m][inside])
        gram, at = (np.concatenate(found), np.concatenate(owners)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        order = np.argsort(at, kind="stable")
        self.gram, self.at, self.n = gram[order], at[order], len(words)
        self.count = np.bincount(self.at, minlength=self.n)
        self.start = np.concatenate([[0], np.cumsum(self.count)[:-1]]).astype(np.int64)

    def mean(self, table: np.ndarray) -> np.ndarray:
        """Per word the mean of its n-grams' rows; every word has at least one n-gram."""
        return (np.add.reduceat(table[self.gram], self.start) / self.count.reshape(-1, *[1] * (table.ndim - 1))).astype(np.float32)

    def most(self, table: np.ndarray) -> np.ndarray:
        return np.maximum.reduceat(table[self.gram], self.start)


def presence(each: list[list[int]], labels: np.ndarray, g: Grams) -> np.ndarray:
    """[word or n-gram, label, bucket]: in how many texts a bucket occurs."""
    seen = np.zeros((2, 2, BUCKETS), np.int32)
    stops = np.append(g.start[1:], len(g.gram)) if g.n else g.start
    for ids, y in zip(each, labels, strict=True):
        words = np.unique(np.asarray(ids, np.int64))
        seen[0, y, np.unique(g.word[words])] += 1
        if len(words):
            seen[1, y, np.unique(np.concatenate([g.gram[g.start[w] : stops[w]] for w in words]))] += 1
    return seen


def log_odds(seen: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log-odds per word bucket and per n-gram bucket."""
    rate = min(max(rate, 1e-3), 1 - 1e-3)
    odds = np.log((seen[:, 1] + PSEUDO * rate) / (seen[:, 0] + PSEUDO * (1 - rate)) * (1 - rate) / rate)
    return odds[0].astype(np.float32), odds[1].astype(np.float32)


def windows(n: int) -> list[tuple[int, int]]:
    """(start, stop) of overlapping windows that cover n words."""
    return [(s, min(n, s + WINDOW)) for s in range(0, max(n - (WINDOW - STRIDE), 1), STRIDE)] if n else []


def grid(each: list[list[int]], cuts: list[tuple[int, int, int]]) -> np.ndarray:
    """Word numbers of windows (text, start, stop), padded with -1."""
    out = np.full((len(cuts), WINDOW), -1, np.int32)
    for k, (i, s, e) in enumerate(cuts):
        out[k, : e - s] = each[i][s:e]
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters by name; the two directions are the first axis of the recurrent ones."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
        self.p = {
            "words": (0.1 * r.standard_normal((BUCKETS, EMBED))).astype(np.float32),
            "grams": (0.1 * r.standard_normal((BUCKETS, EMBED))).astype(np.float32),
            "w": draw(2, DEPTH, 3 * HIDDEN), "u": draw(2, HIDDEN, 3 * HIDDEN), "b": np.zeros((2, 1, 3 * HIDDEN), np.float32),
            "wa": draw(2 * HIDDEN, ATTEND), "va": draw(ATTEND, 1)[:, 0], "out": draw(2 * HIDDEN, 1)[:, 0], "bias": np.zeros(1, np.float32),
        }
        self.odds: tuple[np.ndarray, np.ndarray] = (np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32))

    def inputs(self, g: Grams, odds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        if not g.n:
            return np.zeros((0, DEPTH), np.float32)
        w, c = odds
        return np.concatenate([w[g.word][:, None], g.mean(c)[:, None], g.most(c)[:, None], self.p["words"][g.word], g.mean(self.p["grams"])], 1)

    def forward(self, x: np.ndarray, ids: np.ndarray, keep: bool = False):
        """Logits of windows of word numbers; x has a row per distinct word."""
        p, H = self.p, HIDDEN
        gates = np.stack([x @ p["w"][d] + p["b"][d] for d in (0, 1)])
        n, T = ids.shape
        mask = ids >= 0
        states = np.zeros((2, T, n, H), np.float32)
        h = np.zeros((2, n, H), np.float32)
        full = bool(mask.all())
        trace = []
        for t in range(T):
            cols = (ids[:, t], ids[:, T - 1 - t])
            a = np.stack([gates[d][cols[d]] for d in (0, 1)])
            r = np.matmul(h, p["u"])
            zr = sigmoid(a[..., : 2 * H] + r[..., : 2 * H])
            z, s = zr[..., :H], zr[..., H:]
            c = 2 * sigmoid(2 * (a[..., 2 * H :] + s * r[..., 2 * H :])) - 1
            new = h + z * (c - h)
            if not full:
                m = np.stack([mask[:, t], mask[:, T - 1 - t]])[..., None]
                new = np.where(m, new, h)
            if keep:
                trace.append((h, z, s, c, r[..., 2 * H :]))
            h = new
            states[0, t], states[1, T - 1 - t] = h[0], h[1]
        both = np.concatenate([states[0], states[1]], -1)  # T, n, 2H
        e = np.tanh(both @ p["wa"])
        score = np.where(mask.T, e @ p["va"], -1e9)
        score = np.exp(score - score.max(0))
        alpha = score / score.sum(0)
        pooled = (alpha[..., None] * both).sum(0)
        logit = pooled @ p["out"] + p["bias"][0]
        return (logit, (mask, trace, both, e, alpha, pooled)) if keep else logit

    def gradient(self, g: Grams, x: np.ndarray, ids: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], float]:
        """Gradient of the weighted log loss."""
        p, H = self.p, HIDDEN
        logit, (mask, trace, both, e, alpha, pooled) = self.forward(x, ids, True)
        n, T = ids.shape
        prob = sigmoid(logit)
        loss = float(-(weight * np.log(np.where(y > 0, prob, 1 - prob) + 1e-7)).sum())
        d = {k: np.zeros_like(v) for k, v in p.items()}
        dl = (weight * (prob - y)).astype(np.float32)
        d["out"], d["bias"][0] = pooled.T @ dl, dl.sum()
        dp = dl[:, None] * p["out"]
        da = (both * dp).sum(-1)
        ds = alpha * (da - (alpha * da).sum(0))
        dboth = alpha[..., None] * dp
        d["va"] = np.einsum("tn,tna->a", ds, e)
        de = ds[..., None] * p["va"] * (1 - e * e)
        d["wa"] = np.einsum("tnh,tna->ha", both, de)
        dboth += de @ p["wa"].T
        dx = np.zeros_like(x)
        dh = np.zeros((2, n, H), np.float32)
        for t in range(T - 1, -1, -1):
            h, z, s, c, r = trace[t]
            dh[0] += dboth[t, :, :H]
            dh[1] += dboth[T - 1 - t, :, H:]
            cols = np.stack([ids[:, t], ids[:, T - 1 - t]])
            m = (cols >= 0)[..., None]
            dn = np.where(m, dh, 0)
            dz = dn * (c - h) * z * (1 - z)
            dc = dn * z * (1 - c * c)
            dsr = dc * r * s * (1 - s)
            drec = np.concatenate([dz, dsr, dc * s], -1)
            dgate = np.concatenate([dz, dsr, dc], -1)
            d["u"] += np.matmul(h.transpose(0, 2, 1), drec)
            dh = np.where(m, dn * (1 - z), dh) + np.matmul(drec, p["u"].transpose(0, 2, 1))
            for k in (0, 1):
                ok = m[k, :, 0]
                rows = cols[k][ok]
                d["w"][k] += x[rows].T @ dgate[k][ok]
                d["b"][k] += dgate[k][ok].sum(0)
                np.add.at(dx, rows, dgate[k][ok] @ p["w"][k].T)
        used = np.flatnonzero(np.abs(dx).sum(1))
        np.add.at(d["words"], g.word[used], dx[used, 3 : 3 + EMBED])
        inside = np.isin(g.at, used)
        np.add.at(d["grams"], g.gram[inside], dx[g.at[inside], 3 + EMBED :] / g.count[g.at[inside], None])
        return d, loss

    def best(self, each: list[list[int]], x: np.ndarray) -> np.ndarray:
        """Largest window logit of each text; -inf without words."""
        cuts = [(i, s, e) for i, ws in enumerate(each) for s, e in windows(len(ws))]
        out = np.full(len(each), -np.inf)
        cuts.sort(key=lambda c: c[2] - c[1] < WINDOW)  # full windows first: they need no mask
        for k in range(0, len(cuts), BLOCK):
            part = cuts[k : k + BLOCK]
            np.maximum.at(out, [c[0] for c in part], self.forward(x, grid(each, part)))
        return out


def numbered(texts: list[str | None]) -> tuple[list[list[int]], Grams]:
    each, distinct = split(texts)
    at = {w: i for i, w in enumerate(distinct)}
    return [list(map(at.__getitem__, ws)) for ws in each], Grams(distinct)


def train(texts: list[str], labels: list[int], seed: int = 7) -> Network | float:
    """A network, or the share of toxic rows where there is nothing to tell apart."""
    y = np.array(labels, np.int64)
    if len(y) < 20 or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    r = np.random.default_rng(seed)
    net = Network(seed)
    half = r.integers(0, 2, len(y))
    kept_back = r.random(len(y)) < 0.2
    chunks = [np.arange(i, min(i + CHUNK, len(y))) for i in range(0, len(y), CHUNK)]
    seen = np.zeros((2, 2, 2, 2, BUCKETS), np.int32)  # by half and by whether kept back
    for rows in chunks:
        each, g = numbered([texts[i] for i in rows])
        for h in (0, 1):
            for k in (0, 1):
                own = np.flatnonzero((half[rows] == h) & (kept_back[rows] == k))
                seen[h, k] += presence([each[i] for i in own], y[rows[own]], g)
    crossed = [log_odds(seen[1 - k].sum(0), y[half != k].mean()) for k in (0, 1)]
    picked, target, fold = [], [], []
    for rows in chunks:
        words, distinct = split([texts[i] for i in rows])
        at = {w: i for i, w in enumerate(distinct)}
        g = Grams(distinct)
        clue = [np.maximum(o[0][g.word], g.most(o[1])) for o in crossed] if g.n else []
        for i, ws in zip(rows.tolist(), words, strict=True):
            own = windows(len(ws))
            if not own or kept_back[i]:
                continue
            heat = clue[half[i]][[at[w] for w in ws]]
            top = int(np.argmax([heat[s:e].max() for s, e in own]))
            for k in {top} if y[i] else {top, *r.integers(0, len(own), 2).tolist()}:
                picked.append(ws[slice(*own[k])])
                target.append(y[i])
                fold.append(half[i])
    distinct = list(dict.fromkeys(w for ws in picked for w in ws))
    at, g = {w: i for i, w in enumerate(distinct)}, Grams(distinct)
    each = [[at[w] for w in ws] for ws in picked]
    ids, target, fold = grid(each, [(i, 0, len(ws)) for i, ws in enumerate(each)]), np.array(target), np.array(fold)
    weight = np.where(target > 0, 0.5 / max(target.mean(), 1e-3), 0.5 / max(1 - target.mean(), 1e-3))
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for _ in range(EPOCHS):
        for k in (0, 1):
            own = r.permutation(np.flatnonzero(fold == k))
            for s in range(0, len(own), GROUP):
                rows = own[s : s + GROUP]
                words, local = np.unique(ids[rows], return_inverse=True)
                local = local.reshape(len(rows), WINDOW) - (words[0] < 0)
                sub = g_subset(g, words[words >= 0])
                x = net.inputs(sub, crossed[k])
                d, _ = net.gradient(sub, x, local, target[rows], weight[rows] / len(rows))
                step += 1
                for name, grad in d.items():
                    m, v = moment[name]
                    m += 0.1 * (grad - m)
                    v += 0.01 * (grad * grad - v)
                    net.p[name] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    net.odds = log_odds(seen[:, 0].sum(0), y[~kept_back].mean())
    back = np.flatnonzero(kept_back)
    if len(back) and y[back].min() != y[back].max():
        logit = [net.best(each, net.inputs(g, net.odds)) for i in range(0, len(back), CHUNK) for each, g in [numbered([texts[j] for j in back[i : i + CHUNK]])]]
        net.p["bias"][0] -= cut_at(np.concatenate(logit), y[back])
    net.odds = log_odds(seen.sum((0, 1)), y.mean())
    return net


def g_subset(g: Grams, words: np.ndarray) -> Grams:
    out = Grams.__new__(Grams)
    out.n, out.word, out.count = len(words), g.word[words], g.count[words]
    out.start = np.concatenate([[0], np.cumsum(out.count)[:-1]]).astype(np.int64) if len(words) else np.zeros(0, np.int64)
    out.at = np.repeat(np.arange(len(words)), out.count)
    out.gram = g.gram[np.repeat(g.start[words] - out.start, out.count) + np.arange(int(out.count.sum()))]
    return out


def cut_at(logit: np.ndarray, y: np.ndarray) -> float:
    """The logit, midway between neighbours, that parts the classes with the best F1."""
    order = np.argsort(-logit)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    low = logit[order[k + 1]] if k + 1 < len(y) else logit[order[k]] - 1
    return float((logit[order[k]] + max(low, logit[order[k]] - 4)) / 2)


def fit(docs: DataFrame, labels: DataFrame, usable: Column) -> Network | float:
    """Learn from documents (doc_id, text) with a label (doc_id, toxic) where `usable`."""
    rows = labels.where(usable & F.col("toxic").isNotNull()).select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_y"))
    ids = rows.withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id", "_y").limit(SAMPLE_ROWS)
    # SAMPLE_ROWS ids are sent out; as many texts come back
    found = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id")).where("text is not null")
    found = found.select("_h", "doc_id", "text", "_y", F.xxhash64("text").alias("_t"))
    key = ["_h", "doc_id", "_y", "_t"]
    sizes = found.groupBy(*key).agg(F.sum(F.octet_length("text").cast("long")).alias("n")).collect()
    taken, held = [], 0
    for r in sorted(sizes, key=lambda r: [r[k] for k in key]):
        # a text that does not fit is left out, those after it are not
        if held + r["n"] <= SAMPLE_BYTES:
            held += r["n"]
            taken.append(tuple(r[k] for k in key))
    kept = docs.sparkSession.createDataFrame(taken, found.select(*key).schema)
    rows = found.join(F.broadcast(kept), key, "left_semi").collect()  # at most SAMPLE_BYTES of text
    rows.sort(key=lambda r: (r["_h"], r["doc_id"], r["text"]))
    texts, toxic = [r["text"] for r in rows], [r["_y"] for r in rows]
    del rows, sizes, kept, taken  # the driver needs its memory for what follows
    model = train(texts, toxic)
    del texts
    gc.collect()
    return model


def score(docs: DataFrame, model: Network | float, text: str = "text") -> tuple[DataFrame, list[str]]:
    """docs with (score, predicted); the names they got come second."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(lists: Iterator[list]) -> Iterator[list]:
        net = sent.value
        for texts in lists:
            if isinstance(net, float):
                s = np.full(len(texts), net)
            else:
                each, g = numbered(texts)
                s = sigmoid(net.best(each, net.inputs(g, net.odds))) if g.n else np.zeros(len(texts))
                s[[not ws for ws in each]] = 0.0
            yield [pa.array(s.astype(np.float64), pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())]

    return common.appended(docs, text, run, [("score", "double"), ("predicted", "int")])


def learnable(doc_id: Column) -> Column:
    return common.crc_mod(doc_id, 5) != 0


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    scored, (_, predicted) = score(docs, fit(docs, labels, learnable(F.col("doc_id"))))
    return scored.where(F.col(predicted) == 0).select(*docs.columns)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learnt from labels that are not held out."""
    docs = common.documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), learnable(F.col("doc_id")))
    scored, _ = score(docs.select("doc_id", "text"), model)
    held = F.coalesce(common.crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


QUERIES = {"op10_toxicity": op10_toxicity}
