"""Files written per key, and listed."""

import os

from pyspark.sql import functions as F

from tallyforge.sources import folders


def test_a_file_per_key_holds_its_rows_and_no_task_moves_files_one_by_one(spark, tmp_path):
    rows = [(k, f"é {k} {i}" if i else "") for k in range(300) for i in range(k % 7)] + [(None, "lost"), (7, None)]
    df = spark.createDataFrame(rows, "k long, value string").repartition(5)
    folders.write_lines(df, f"file://{tmp_path}/out", ["k"])
    want = {}
    for k, v in rows:
        want.setdefault("__HIVE_DEFAULT_PARTITION__" if k is None else str(k), []).append(v or "")
    got = {}
    for at, _, names in os.walk(tmp_path / "out"):
        if names:
            assert names == ["part.txt"]
            with open(f"{at}/part.txt") as f:
                got[os.path.basename(at).removeprefix("k=")] = f.read().removesuffix("\n").split("\n")
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    back = spark.read.schema("value string, k long").text(f"file://{tmp_path}/out")
    assert sorted(map(repr, back.select("k", "value").collect())) == sorted(repr(r) for r in spark.createDataFrame([(k, v or "") for k, v in rows], "k long, value string").collect())


def test_keys_of_several_columns_and_no_line_end(spark, tmp_path):
    df = spark.createDataFrame([("a/b", 1, "x\ny"), ("a/b", 2, "z"), ("c", 1, "")], "a string, b int, value string")
    folders.write_lines(df, f"{tmp_path}/out", ["a", "b"], end="")
    texts = {r["path"]: r["bytes"] for r in folders.listing(spark, f"{tmp_path}/out").collect()}
    assert {p.split("/out/")[1]: n for p, n in texts.items()} == {"a=a%2Fb/b=1/part.txt": 3, "a=a%2Fb/b=2/part.txt": 1, "a=c/b=1/part.txt": 0}


def test_listing_is_what_spark_lists(spark, tmp_path):
    for name in ("a.txt", "x/b.txt", "x/y/c.txt", "x/y/z/d.txt", "x/_no/e.txt", "x/.no/f.txt", "x/_k=1/g.txt", "x/y/_SUCCESS", "x/y/h.json", "e/.i.crc"):
        at = tmp_path / "in" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(name)
    (tmp_path / "in" / "none").mkdir()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(f"file://{tmp_path}/in")
    want = raw.select("path", F.col("length").alias("bytes"), F.date_trunc("second", "modificationTime").alias("modified"))
    got = folders.listing(spark, f"file://{tmp_path}/in", "*.txt").withColumn("modified", F.date_trunc("second", "modified"))
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 5
    assert folders.listing(spark, f"{tmp_path}/in/none").count() == 0
