import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tallyforge.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(conversations):
    """{(depth, smallest member): node} of {conv_id: [(role, text)]}, prefix by prefix."""
    nodes = {}
    for c, said in conversations.items():
        for d in range(len(said) + 1):
            nodes.setdefault(tuple(said[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        kids = {q for q in below if len(q) == len(p) + 1}
        leaves = [q for q in below if not any(x[: len(q)] == q and len(x) > len(q) for x in nodes)]
        ends = ",".join(str(c) for c in sorted(members) if len(conversations[c]) == len(p))
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def as_table(spark, conversations):
    return spark.createDataFrame([(c, i, r, t) for c, said in conversations.items() for i, (r, t) in enumerate(said)], SCHEMA)


def of(spark, table):
    ids = table.select("conv_id").where("conv_id is not null").distinct()
    return trie.prefix_trie(trie.turns(table), ids)


def test_random_tries(spark):
    rng = random.Random(5)
    for few in (1, 3):
        made = {}
        for c in range(60):
            if made and rng.random() < 0.4:
                made[c * 7 - 100] = list(made[rng.choice(list(made))])
            else:
                made[c * 7 - 100] = [(rng.choice("ua"), rng.choice(["x", "yy", "", "äöü"][:few])) for _ in range(rng.randrange(1, 7))]
        assert rows(of(spark, as_table(spark, made))) == plain(made)


def test_long_chains_and_one_conversation(spark):
    long = [("u", f"turn {i}") for i in range(300)]
    made = {1: long, 2: list(long), 3: [*long[:3], ("a", "other")], 9: long[:5]}
    assert rows(of(spark, as_table(spark, made))) == plain(made)
    assert rows(of(spark, as_table(spark, {4: [("u", "a"), ("a", "b")]}))) == plain({4: [("u", "a"), ("a", "b")]})
    copies = {c: [("u", "same"), ("a", "same again")] for c in range(50)}
    assert rows(of(spark, as_table(spark, copies))) == plain(copies)


def test_nulls_ties_and_empty(spark):
    table = spark.createDataFrame([(1, None, "u", "first"), (1, 0, None, None), (1, 0, "", ""), (2, 5, "u", "first"), (2, 9, None, ""), (None, 0, "u", "first"), (3, 1, "u", "firs"), (3, 1, "ut", "x"), (3, 0, "u", "first")], SCHEMA)
    made = {1: [("u", "first"), ("", ""), ("", "")], 2: [("u", "first"), ("", "")], 3: [("u", "first"), ("u", "firs"), ("ut", "x")]}
    assert rows(of(spark, table)) == plain(made)
    assert rows(of(spark, table.withColumns({c: F.lit("z") for c in ("part", "key", "pos", "n", "rep", "class")}))) == plain(made)
    assert rows(of(spark, table.where("false"))) == []


def test_rebuilt(spark):
    """Own turns after the first h, on the first h of the conversation of the hundred."""
    rng = random.Random(8)
    own = {c: [(rng.choice("ua"), f"{rng.randrange(4)}") for _ in range(rng.randrange(1, 9))] for c in [*range(100, 130), *range(201, 215), 300, -7, -130]}
    made = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 6, c - int(__import__("math").fmod(c, 100))
        made[c] = own.get(base, [])[:h] + own[c][h:]
    table = as_table(spark, own)
    ids = table.select("conv_id").distinct()
    said = trie.rebuilt(trie.turns(table), ids, F.col("conv_id") - F.col("conv_id") % 100, F.crc32(F.col("conv_id").cast("string")) % 6)
    got = rows(trie.prefix_trie(said, ids))
    assert any(not x for x in made.values())
    assert got == plain(made)


def test_many_ends_are_digested_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "JOINED", 20)
    members = spark.range(0, 500).select(F.lit(3).cast("long").alias("rep"), F.col("id").alias("conv_id"), F.lit(500).cast("long").alias("n"))
    members = members.unionByName(spark.createDataFrame([(9, 9, 1), (11, 11, 2), (11, -5, 2)], "rep long, conv_id long, n long"))
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert {r["rep"]: r["ends_sha256"] for r in trie.ends(members.repartition(7)).collect()} == {3: sha(range(500)), 9: sha([9]), 11: sha([-5, 11])}


def test_running_sums_over_one_large_group(spark):
    df = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5).alias("g"), F.col("id").alias("o"), F.lit("x").alias("part"))
    out = trie.running(df.repartition(8), "g", ["o"], {"at": F.lit(1).cast("long"), "total": F.col("o")})
    want, n, total = [], {}, {}
    for i in range(3000):
        g = 1 if i % 3 == 0 else i % 5
        n[g], total[g] = n.get(g, 0) + 1, total.get(g, 0) + i
        want.append((g, i, n[g], total[g]))
    assert sorted((r["g"], r["o"], r["at"], r["total"]) for r in out.collect()) == sorted(want)
    assert set(out.columns) == {"g", "o", "part", "at", "total"}
