"""Outlooks of tasks on random graphs against a plain version."""

import random

from tallyforge.operators import tasks


def plain(states, policies, needs):
    def behind_circle(t, seen=()):
        return t in seen or any(behind_circle(n, (*seen, t)) for n in needs.get(t, ()))

    dead = {t for t, s in states.items() if s == "failed"}
    while more := {t for t, s in states.items() if s == "open" and policies[t] == "failFast" and t not in dead and needs.get(t, set()) & dead}:
        dead |= more
    out = {}
    for t, s in states.items():
        wanted = needs.get(t, set())
        fine = {n for n in wanted if states.get(n) == "done" or (policies[t] == "allSettled" and n in dead)}
        out[t] = s if s != "open" else "circular" if behind_circle(t) else "doomed" if t in dead else "ready" if fine == wanted else "waiting"
    return out


def test_random_graphs(spark):
    rng = random.Random(3)
    seen = set()
    for _ in range(3):
        states = {t: rng.choice(["done", "done", "failed", "open", "open", "open"]) for t in range(40)}
        policies = {t: rng.choice(["failFast", "allSettled"]) for t in states}
        edges = [(rng.randrange(1, 40), 0) for _ in range(3)]
        edges = [(t, rng.randrange(t)) for t, _ in edges] + [(t, rng.randrange(t)) for t in range(1, 40) for _ in range(rng.randrange(3))] + [(5, 9), (9, 5), (30, 30), (12, 77)]
        needs = {}
        for t, n in edges:
            needs.setdefault(t, set()).add(n)
        frame = spark.createDataFrame([(t, states[t], policies[t]) for t in states] + [(None, "open", "failFast")], "task long, state string, policy string")
        links = spark.createDataFrame([*edges, edges[0], (None, 1), (3, None)], "task long, need long")
        got = {r["task"]: r["outlook"] for r in tasks.outlook(frame, links).collect()}
        assert got == plain(states, policies, needs)
        seen |= set(got.values())
    assert seen == {"done", "failed", "circular", "doomed", "ready", "waiting"}


def test_no_needs_and_no_tasks(spark):
    frame = spark.createDataFrame([(1, "open", "failFast")], "task long, state string, policy string")
    links = spark.createDataFrame([], "task long, need long")
    assert [tuple(r) for r in tasks.outlook(frame, links).collect()] == [(1, "open", "ready")]
    assert tasks.outlook(frame.where("false"), links).count() == 0 and tasks.circular(links).count() == 0
