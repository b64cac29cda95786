"""Small files are read by the hundred in a task, in Arrow batches."""

import random

from tallyforge.sources import logscan


def test_small_files_share_tasks_and_large_ones_do_not(tmp_path):
    for i in range(500):
        (tmp_path / f"{i}.jsonl").write_text("a\nb\n")
    parts = logscan.LogReader({"path": str(tmp_path)}).partitions()
    assert len(parts) == 3 and sum(len(p.items) for p in parts) == 500
    assert len(logscan.LogReader({"path": str(tmp_path), "range": "8"}).partitions()) == 250  # two files of 4 bytes


def test_batches_are_the_rows(tmp_path, monkeypatch):
    monkeypatch.setattr(logscan, "BLOCK", 5)
    monkeypatch.setattr(logscan.BatchReader, "ROWS", 7)
    monkeypatch.setattr(logscan.BatchReader, "BYTES", 60)
    rng = random.Random(2)
    for i in range(30):
        lines = [bytes(rng.choices(b"ab\xc3\xa9\xff ", k=rng.randrange(9))) for _ in range(rng.randrange(12))]
        (tmp_path / f"2024-05-0{1 + i % 9}T08-25-07-381Z_{i}.jsonl").write_bytes(b"\n".join(lines) + rng.choice([b"", b"\n", b"\n\n"]))
    for size in ("6", "20", "1000"):
        one, many = (cls({"path": str(tmp_path), "range": size}) for cls in (logscan.LogReader, logscan.BatchReader))
        want = [row for p in one.partitions() for row in one.read(p)]
        got = [tuple(r.values()) for p in many.partitions() for b in many.read(p) for r in b.to_pylist()]
        assert got == want
    (grown,) = [x for p in many.partitions() for x in p.items if x[0].endswith("_3.jsonl")]
    with open(grown[0], "ab") as f:
        f.write(b"later\nlines\n")
    assert [tuple(r.values()) for b in many.read(logscan.Ranges([grown])) for r in b.to_pylist()] == list(one.read(logscan.Ranges([grown])))
