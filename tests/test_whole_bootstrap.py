"""a24 draws 4,000 resamples, against brute force."""

import hashlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from tallyforge.plans import pairs

SF = "/root/testdata/sf0.001"


def test_four_thousand_resamples(spark):
    nation = {r["c_custkey"]: r["c_nationkey"] for r in pq.read_table(f"{SF}/customer.parquet").to_pylist()}
    sums = {}
    for o in pq.read_table(f"{SF}/orders.parquet").to_pylist():
        if o["o_custkey"] in nation:
            s = sums.setdefault(nation[o["o_custkey"]], [0.0, 0])
            s[0] += float(o["o_totalprice"])
            s[1] += 1
    s = np.array([sums[k] for k in sorted(sums)])
    pick = lambda rep, slot: int(hashlib.sha256(f"1:{rep}:{slot}".encode()).hexdigest()[:13], 16) % len(s)
    drawn = [s[[pick(rep, slot) for slot in range(len(s))]].sum(axis=0) for rep in range(4_000)]
    low, high = np.percentile([a / b for a, b in drawn], [2.5, 97.5])
    got = pairs.a24(spark, SF).first()
    assert got["replicates"] == 4_000
    assert float(got["low"]) == pytest.approx(low, abs=1e-3) and float(got["high"]) == pytest.approx(high, abs=1e-3)
