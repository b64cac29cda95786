import json

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import graphs, models, pairing, similarity
from tallyforge.sources import logs
from tallyforge.streaming import feeds

SCHEMA = "type string, id long"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a").mkdir()
    good = [json.dumps({"type": "header", "id": 0}), json.dumps({"type": "message", "id": 1})]
    (tmp_path / "a" / "2024-05-01T08-25-07-381Z.jsonl").write_text("\n".join(good) + "\n")
    (tmp_path / "2024-06-01T00-00-00-000Z.jsonl").write_text("\n".join(good) + '\n{"type": "mess')
    return tmp_path


def test_log_readers(spark, folder):
    f = str(folder)
    assert logs.read_skipping(spark, f, SCHEMA).count() == 4
    counts = {r["path"][-30:]: (r["lines"], r["malformed"]) for r in logs.malformed_counts(spark, f, SCHEMA).collect()}
    assert sorted(counts.values()) == [(2, 0), (3, 1)]
    assert logs.read_strict(spark, f, SCHEMA).count() == 4
    assert {r["type"] for r in logs.headers(spark, f, SCHEMA).collect()} == {"header"}
    assert logs.newer_than(logs.lines(spark, f), "2024-05-15").select("path").distinct().count() == 1
    (folder / "bad.jsonl").write_text('{"type": "x"}\nnot json\n{"type": "y"}\n')
    with pytest.raises(Exception, match="bad line 1"):
        logs.read_strict(spark, f, SCHEMA).collect()


def test_export_and_manifest(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "train"), (3, "dev")], "id long, split string")
    logs.write_split(df, f"{tmp_path}/out")
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        logs.write_split(df, f"{tmp_path}/out")
    a = {tuple(r) for r in logs.manifest(df, "id", "split").collect()}
    assert a == {tuple(r) for r in logs.manifest(df.orderBy(F.desc("id")).repartition(3), "id", "split").collect()} and len(a) == 2
    (tmp_path / "m.txt").write_text('# HELP x\nx_total{a="b"} 3\ny 2.5\n')
    assert {(r["name"], r["value"]) for r in logs.metrics(spark, f"{tmp_path}/m.txt").collect()} == {("x_total", 3.0), ("y", 2.5)}


def test_windows_and_loop_guard(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    actions = [("s", i, a, False) for i, a in enumerate("abacbd")] + [("s", 6, "w", True), ("s", 7, "a", False), ("s", 8, "a", False)]
    (tmp_path / "in").mkdir()
    spark.createDataFrame(actions, "session string, seq long, action string, changes boolean").coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    feed = feeds.change_feed(spark, f"{tmp_path}/in", "session string, seq long, action string, changes boolean")
    q = feeds.loop_guard(feed).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["seq"], r["distance"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(2, 2), (4, 3), (8, 1)]


def test_graphs(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    nodes = spark.createDataFrame([(7,), (500,)], "node long")
    got = {r["node"]: r["component"] for r in graphs.components(edges, nodes).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100 and got[500] == 500
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 2)], "node long, parent long")
    assert sorted(tuple(r) for r in graphs.root_paths(tree).collect()) == [(1, 1, 0), (2, 1, 1), (2, 2, 0), (3, 1, 2), (3, 2, 1), (3, 3, 0), (4, 1, 2), (4, 2, 1), (4, 4, 0)]
    ring = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, None), (5, 4), (6, 6), (7, 99)], "node long, parent long")
    assert sorted(tuple(r) for r in graphs.root_paths(ring).collect()) == [(4, 4, 0), (5, 4, 1), (5, 5, 0), (7, 7, 0), (7, 99, 1)]
    assert sorted(r["node"] for r in graphs.circular(ring).collect()) == [1, 2, 3, 6]
    deep = spark.createDataFrame([(i, i - 1 if i else None) for i in range(130)], "node long, parent long")
    assert graphs.root_paths(deep).where("node = 129").count() == 130 and graphs.circular(deep).count() == 0


def test_pairs_and_models(spark):
    a = spark.createDataFrame([("x", True, 100.0), ("y", True, 100.0), ("z", False, 100.0), ("lost", True, 1.0)], "block string, passed boolean, cost double")
    b = spark.createDataFrame([("x", True, 50.0), ("y", False, 300.0), ("z", True, 80.0)], "block string, passed boolean, cost double")
    r = pairing.paired_statistics(pairing.paired(a, b, "block"), "passed", "cost").first()
    assert (r["n"], r["base_only"], r["arm_only"], r["n_both"], r["base_total"], r["arm_total"], r["geo_ratio"]) == (3, 1, 1, 1, 300.0, 430.0, 0.5)
    flat = spark.createDataFrame([(c, 2.0, 1.0) for c in range(5)], "c long, a double, b double")
    i = pairing.cluster_bootstrap(flat, "c", "a", "b", 50).first()
    assert i["low"] == i["high"] == 2.0
    s = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)], "s double, y int")
    assert abs(models.auc(s, "s", "y").first()["auc"] - (1 + 2 + 1.5) / 6) < 1e-12
    assert models.auc(s.where("y = 1"), "s", "y").first()["auc"] is None
    w = models.logistic(s, ["s"], "y", l2=1e-6)
    assert w[1] > 0


def test_jaccard_pairs_equal_brute_force(spark):
    texts = ["the cat sat on the mat", "the cat sat on the map", "a wholly other line", "the cat sat", "xy", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    sets = {i: {t[j : j + 5] for j in range(len(t) - 4)} for i, t in enumerate(texts) if t}
    want = {(i, j) for i in sets for j in sets if i < j and sets[i] | sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.4}
    got = {(r["x"], r["y"]) for r in similarity.jaccard_pairs(similarity.gram_sets(df, "k", "t"), None, 0.4).collect()}
    assert got == want
