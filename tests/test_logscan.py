"""The log source: first lines without the rest, files pruned by the time in their name, ranges."""

import random

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import logscan


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())


def stamp(day):
    return f"2024-05-{day:02d}T08-25-07-381Z"


def test_first_lines_do_not_read_on(spark, tmp_path):
    for i, size in enumerate((10, 1_000_000, 8_000_000)):
        write(tmp_path, f"a/{stamp(i + 1)}_x{i}.jsonl", f'{{"id": {i}}}\n' + "y" * size)
    reads = []
    for i in range(3):
        r = logscan.LogReader({"path": str(tmp_path), "only": "first"})
        (items,) = [[x for x in p.items if f"x{i}." in x[0]] for p in r.partitions()]
        assert [line for *_, line in r.read(logscan.Ranges(items))] == [f'{{"id": {i}}}']
        reads.append(r.bytes_read)
    assert max(reads) <= logscan.BLOCK
    got = logscan.scan(spark, str(tmp_path), only="first").select("line", "start").collect()
    assert sorted(r["line"] for r in got) == [f'{{"id": {i}}}' for i in range(3)] and {r["start"] for r in got} == {0}


def test_files_of_other_times_are_never_opened(spark, tmp_path):
    for day in range(1, 10):
        write(tmp_path, f"{stamp(day)}.jsonl", f"{day}\nmore\n")
    write(tmp_path, "no-time.jsonl", "x\n")
    write(tmp_path, "_SUCCESS.jsonl", "x\n")
    r = logscan.LogReader({"path": str(tmp_path), "since": "2024-05-04", "before": "2024-05-06"})
    lines = [row[3] for p in r.partitions() for row in r.read(p)]
    assert sorted(lines) == ["4", "5", "more", "more"] and len(r.opened) == 2
    late = logscan.scan(spark, str(tmp_path), since="2024-05-08T00:00:00+00:00")
    assert sorted(r["line"] for r in late.where("line <> 'more'").collect()) == ["8", "9"] and late.count() == 4
    every = logscan.scan(spark, str(tmp_path))
    assert every.where("time >= '2024-05-08'").count() == 4 and every.count() == 19
    assert logscan.scan(spark, str(tmp_path), only="names").where(F.col("time").isNull()).count() == 1


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_ranges_give_every_line_once(tmp_path, monkeypatch, size):
    monkeypatch.setattr(logscan, "BLOCK", 3)
    rng = random.Random(size)
    for i in range(4):
        text = "\n".join("é" * rng.randrange(4) + "z" * rng.randrange(6) for _ in range(12)) + rng.choice(["", "\n"])
        write(tmp_path, f"{i}.jsonl", text)
        want = []
        place = 0
        for line in text.encode().removesuffix(b"\n").split(b"\n"):
            want.append((place, line.decode()))
            place += len(line) + 1
        r = logscan.LogReader({"path": str(tmp_path), "range": str(size), "suffix": f"{i}.jsonl"})
        got = [(row[2], row[3]) for p in r.partitions() for row in r.read(p)]
        assert got == [w for w in want if w[1] or w is not want[-1] or text.endswith("\n")]


def test_odd_folders(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    assert logscan.scan(spark, f"{tmp_path}/empty").count() == 0
    write(tmp_path, "b/none.jsonl", "")
    assert logscan.scan(spark, f"{tmp_path}/b", only="first").count() == 0
    assert logscan.stamp_of("x/2024-13-01T08-25-07-381Z") is None and logscan.reachable("/a") and logscan.reachable("file:///a") and not logscan.reachable("viewfs://store/a")
