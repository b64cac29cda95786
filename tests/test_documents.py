"""Documents written as bases and deltas: chains within the policy, reads as of every change, versions."""

import json
import random

import pytest

from tallyforge.operators import deltas
from tallyforge.streaming import documents

ONE = documents.Definition(1, initial=lambda: {"n": 0, "l": []}, checkpoint_when=lambda value, ops, since: since >= 3 or len(value["l"]) > 6)
TWO = documents.Definition(2, initial=lambda: {"count": 0, "l": []}, migrate=lambda v, old: {"count": v["n"], "l": v["l"], "from": old}, checkpoint_when=lambda value, ops, since: since >= 2)


def stored(spark, path, batches):
    """Revisions of (definition, changes) batches, each a run of the writer."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "document_id long, seq long, ops string"
    for definition, rows in batches:
        spark.createDataFrame([(d, s, json.dumps(o)) for d, s, o in rows], schema).write.mode("append").parquet(f"{path}/in")
        feed = spark.readStream.schema(schema).parquet(f"{path}/in")
        documents.revisions(feed, definition).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(documents.REVISIONS).parquet(f"{path}/out")


def test_reads_equal_a_replay_of_every_change(spark, tmp_path):
    rng = random.Random(7)
    changes = []
    for seq in range(60):
        d = rng.randrange(4)
        changes.append((d, seq, rng.choice([[["s", ["n"], seq]], [["e", ["l"], seq]], [["e", ["l"], seq], ["s", ["n"], -1]], [["p", ["l"], 0, 1, []]]])))
    got = stored(spark, tmp_path, [(ONE, changes[:20] + changes[5:9]), (ONE, changes[20:])]).cache()
    rows = sorted(((r["document_id"], r["seq"], r["kind"]) for r in got.collect()))
    assert len(rows) == len(changes)
    for d in range(4):
        chain = 0
        for _, _, kind in [r for r in rows if r[0] == d]:
            chain = 0 if kind == "base" else chain + 1
            assert chain <= 3
    ids = spark.createDataFrame([(d,) for d in range(5)], "document_id long")
    for at in (*range(0, 60, 7), 59, None):
        want = {d: ONE.initial() for d in range(5)}
        for d, seq, ops in changes:
            if at is None or seq <= at:
                want[d] = deltas.apply(want[d], json.loads(json.dumps(ops)))
        assert {r["document_id"]: json.loads(r["content"]) for r in documents.as_of(got, ONE, at, ids).collect()} == want
    assert documents.as_of(got, ONE, -1).count() == 0


def test_a_new_version_takes_over(spark, tmp_path):
    first = [(1, 0, [["s", ["n"], 5]]), (1, 1, [["e", ["l"], "a"]]), (2, 2, [["s", ["n"], 8]])]
    later = [(1, 3, [["s", ["count"], 6]]), (1, 4, [["e", ["l"], "b"]]), (3, 5, [["e", ["l"], "c"]])]
    got = stored(spark, tmp_path, [(ONE, first), (TWO, later)]).cache()
    assert sorted((r["document_id"], r["seq"], r["kind"], r["version"]) for r in got.collect()) == [(1, 0, "base", 1), (1, 1, "delta", 1), (1, 3, "base", 2), (1, 4, "delta", 2), (2, 2, "base", 1), (3, 5, "base", 2)]
    now = {r["document_id"]: json.loads(r["content"]) for r in documents.as_of(got, TWO).collect()}
    assert now == {1: {"count": 6, "l": ["a", "b"], "from": 1}, 2: {"count": 8, "l": [], "from": 1}, 3: {"count": 0, "l": ["c"]}}
    assert {r["document_id"]: json.loads(r["content"]) for r in documents.as_of(got, ONE, 2).collect()} == {1: {"n": 5, "l": ["a"]}, 2: {"n": 8, "l": []}}
    with pytest.raises(Exception, match="newer"):
        documents.as_of(got, ONE).collect()
