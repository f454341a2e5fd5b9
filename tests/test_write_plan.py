"""The write plan against a registry in dicts: applying it gives the new registry, applying it again changes nothing, and then nothing is left to plan."""

import random

import pytest

from emberline.operators.registry import STEPS, applied, write_plan

EVENTS, STATES, MEMBERS = "event_id long, merged_into long, started_s long, last_s long, n long", "event_id long, zone_id long, rank int, notified_s long", "uid string, event_id long"
CLUSTERS, MERGES = "event_id long, started_s long, last_s long, n long", "absorbed long, survivor long"


def case(seed):
    rng = random.Random(seed)
    events = {e: (None, e * 10, e * 10 + 5, 3) for e in range(1, 21)}
    events[3] = (2, 30, 35, 1)  # a tombstone whose survivor is absorbed now
    states = {(e, rng.randrange(4)): (rng.randrange(4), rng.choice([None, rng.randrange(100)])) for e in rng.sample(range(1, 21), 14) if e != 3}
    members = {f"u{k}": rng.choice([e for e in events if e != 3]) for k in range(30)}
    merges = {2: 1, 5: 4, 6: 5, 22: 7, 9: 22} if seed % 2 else {2: 1}
    clusters = {e: (e * 10, 999, 7) for e in (1, 4, 7, 8, 21)} | {22: (5, 5, 1)} | {10: events[10][1:]}
    assignments = {f"u{k}": rng.choice([1, 2, 6, 8, 21, 22, 9]) for k in range(25, 45)}
    return events, states, members, clusters, merges, assignments


def plain(events, states, members, clusters, merges, assignments):
    def end(e):
        while (to := merges.get(e, events.get(e, (None,))[0])) is not None:
            e = to
        return e

    now = {e: [None, *v] for e, v in clusters.items() if e not in events} | {e: list(v) for e, v in events.items()}
    for e in now:
        if e in clusters and end(e) == e:
            now[e][1:] = clusters[e]
        now[e][0] = None if end(e) == e else end(e)
    held = {}
    for (e, z), (rank, at) in states.items():
        was = held.get((end(e), z), (-1, None))
        held[end(e), z] = (max(rank, was[0]), max((v for v in (at, was[1]) if v is not None), default=None))
    return {k: tuple(v) for k, v in now.items()}, held, {u: end(e) for u, e in assignments.items()} | members


def frames(spark, events, states, members, clusters, merges, assignments):
    return (
        spark.createDataFrame([(e, *v) for e, v in events.items()], EVENTS), spark.createDataFrame([(*k, *v) for k, v in states.items()], STATES), spark.createDataFrame(list(members.items()), MEMBERS),
        spark.createDataFrame([(e, *v) for e, v in clusters.items()], CLUSTERS), spark.createDataFrame(list(merges.items()), MERGES), spark.createDataFrame(list(assignments.items()), MEMBERS),
    )


def dicts(events, states, members):
    return {r[0]: tuple(r)[1:] for r in events.collect()}, {tuple(r)[:2]: tuple(r)[2:] for r in states.collect()}, {r["uid"]: r["event_id"] for r in members.collect()}


@pytest.mark.parametrize("seed", [0, 1])
def test_the_plan_gives_the_new_registry(spark, seed):
    of = case(seed)
    old, outcome = frames(spark, *of)[:3], frames(spark, *of)[3:]
    plan = write_plan(*old, *outcome).cache()
    steps = {r["action"]: r["step"] for r in plan.select("action", "step").distinct().collect()}
    assert all(STEPS[n - 1] == a for a, n in steps.items())
    once = applied(*old, plan)
    got = dicts(*once)
    assert got == plain(*of)
    assert dicts(*applied(*once, plan)) == got
    assert not [r for r in plan.filter("action = 'aggregate'").collect() if r["event_id"] == 10]  # nothing changed there
    kept = [spark.createDataFrame(t.collect(), s) for t, s in zip(once, (EVENTS, STATES, MEMBERS), strict=True)]
    assert write_plan(*kept, *outcome).collect() == []
