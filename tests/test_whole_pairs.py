"""j6 and j15 over all customers and orders, against brute force."""

import bisect
import datetime

import pyarrow.parquet as pq

from tallyforge.plans import pairs

SF = "/root/testdata/sf0.01"


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def test_every_order_has_its_as_of_row(spark):
    signups = {}
    for e in rows("events"):
        if e["event_type"] == "signup":
            signups.setdefault(e["user_id"], []).append((e["ts"], e["event_id"]))
    for known in signups.values():
        known.sort()
    want = {}
    for o in rows("orders"):
        known = signups.get(o["o_custkey"], [])
        at = datetime.datetime(2024, 1, 1) + datetime.timedelta(days=o["o_orderkey"] % 30)
        i = bisect.bisect_right(known, (at, float("inf")))
        want[o["o_orderkey"]] = known[i - 1][1] if i else None
    got = pairs.j15(spark, SF).collect()
    assert len(got) == len(want) and {r["o_orderkey"]: r["event_id"] for r in got} == want


def test_every_customer_has_its_design_row(spark):
    counts = {c["c_custkey"]: [0, 0] for c in rows("customer")}
    for o in rows("orders"):
        if o["o_orderpriority"] in ("1-URGENT", "5-LOW") and o["o_custkey"] in counts:
            counts[o["o_custkey"]][o["o_orderpriority"] == "5-LOW"] += 1
    want = {}
    for k, (a, b) in counts.items():
        why = [w for w, bad in (("no control", a == 0), ("no treatment", b == 0), ("uneven", a != b)) if bad]
        want[k] = (a, b, ",".join(why))
    got = pairs.j6(spark, SF).collect()
    assert len(got) == len(want) and {r["k"]: (r["control"], r["treatment"], r["reasons"]) for r in got} == want
