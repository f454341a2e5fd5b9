"""What met row by row in one region, and now meets by place, by cell or nearest first; each against plainer loops or its plan."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from emberline import registry
from emberline.operators import joins, outline, polygons


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_zones_of_an_account_meet_at_near_places_only(spark, sf_dir):
    plan = plan_of(registry.queries()["geo_03_within_quanta"](spark, sf_dir))
    joins = [line for line in plan.splitlines() if re.search(r"Join Inner.*account_id", line)]
    assert len(joins) == 1 and "lat_e5" in joins[0] and "SQRT" not in joins[0].upper()


def test_fires_of_a_cell_are_counted_before_detections_meet_them(spark, sf_dir):
    plan = plan_of(registry.queries()["agg_39_label_kinds"](spark, sf_dir))
    by_event = [line for line in plan.splitlines() if re.search(r"Aggregate \[event_id", line)]
    assert len(by_event) == 1 and "sum(held" in by_event[0] and "count(" not in by_event[0]


@pytest.mark.parametrize("name", ["jn_02_reignitions", "jn_01_reignition_candidates"])
def test_reaches_grow_until_something_is_found(spark, name):
    """Places from metres to kilometres apart, alone and in heaps, with parents at, within and just beyond each reach."""
    rng = random.Random(7)
    rows = []
    for k in range(400):
        lat, lon = 42.0 + rng.choice([0, 0, 0.05, 0.09, 0.6]) + rng.choice([0, 0.0005, 0.001, 0.004, 0.011, 0.03]), 25.0 + rng.choice([0, 0.0007, 0.002, 0.01, 0.05, 0.12])
        start = rng.randrange(0, 20 * 86400, 3600)
        rows.append((k, lat, lon, start, start + rng.choice([0, 3600, 90000])))
    fires = spark.createDataFrame(rows, "fire_id long, lat double, lon double, started_s long, last_s long")
    km = lambda a, b: math.floor(math.sqrt(((b[2] - a[2]) * (81.936 - 1.3146 * ((a[1] + b[1]) / 2 - 42.7))) ** 2 + ((b[1] - a[1]) * 111.085) ** 2) / 1e-6 + 0.5)
    if name == "jn_02_reignitions":
        want = {}
        for c in rows:
            found = [(km(c, q), q[3], q[0], c[3] - q[4]) for q in rows if 2 * 86400 < c[3] - q[4] <= 6 * 86400 and km(c, q) <= 11_000_000]
            if found:
                want[c[0]] = (min(found)[2], min(found)[3], min(found)[0])
        got = {r["child"]: (r["parent"], r["gap_s"], r["km_q"]) for r in joins.reignitions(fires, fires, F.lit(6 * 86400), 11.0).collect()}
        assert len({min(9, v[2] // 200_000) for v in want.values()}) > 4
    else:
        want = {q[0] for q in rows if any(2 * 86400 <= c[3] - q[4] <= 3 * 86400 and km(c, q) <= 11_000_000 for c in rows)}
        got = {r["fire_id"] for r in joins.followed(fires, 11.0, 2 * 86400, 3 * 86400).collect()}
    assert got == want and 20 < len(want) < 400


def test_pairs_of_places_are_made_for_those_alone_that_near_ones_leave(spark, monkeypatch):
    day, made = 86400, []
    fires = spark.range(2000).select(F.col("id").alias("fire_id"), (42 + F.col("id") % 50 * 0.001).alias("lat"), F.lit(25.0).alias("lon"), (F.floor(F.col("id") / 50) * day).alias("started_s"), (F.floor(F.col("id") / 50) * day).alias("last_s"))
    near = joins.near_places
    monkeypatch.setattr(joins, "near_places", lambda *a: made.append(near(*a)) or made[-1])
    assert joins.reignitions(fires, fires, F.lit(14 * day), 11.0).count() == 37 * 50
    assert sum(df.count() for df in made) < 50 * 50  # all children but those of the first days have a parent at their own place


def test_a_series_has_a_point_for_every_session(spark):
    rows = [(1, f"{k:03}", k * 10_000, 4_200_000 + k * 500, 2_300_000) for k in range(100)] + [(1, f"b{k:03}", k * 10_000 + 60, 4_200_100, 2_300_000 + k // 2 * 300) for k in range(100)]
    rows += [(k, f"{k}-{i}", i * 3000, 4_100_000 + k * 200 + i // 2 * 350, 2_250_100 + i % 3 * 700) for k in range(2, 6) for i in range(7)]
    d = spark.createDataFrame(rows, "fire_id long, uid string, acq_s long, lat_e5 long, lon_e5 long")
    got = {(r["fire_id"], r["at_s"]): (r["cells"], r["edges"]) for r in outline.series(d, "fire_id", points=None).collect()}
    assert sum(k == 1 for k, _ in got) == 100 and len(got) == 100 + 4 * 7
    ends = spark.createDataFrame(sorted(got), "fire_id long, until_s long")
    until = d.join(ends, "fire_id").filter("acq_s <= until_s").select(F.struct("fire_id", "until_s").alias("k"), "lat_e5", "lon_e5")
    assert got == {(r["k"]["fire_id"], r["k"]["until_s"]): (r["cells"], r["edges"]) for r in outline.areas(until, "k").collect()}


@pytest.mark.parametrize("name", ["str_15_alert_decision", "str_15_sending_zones", "str_23_account_decisions", "udf_21_decision_traces", "win_10_notifying_zone", "jn_10_box_candidates", "jn_07_zone_matches", "jn_05_within_perimeters", "agg_08_distance_to_members"])
def test_pairs_are_made_of_lists(spark, sf_dir, name):
    """What meets last are lists of a place's rows, so no join buffers or reads them one by one for each row of the other side."""
    plan = plan_of(registry.queries()[name](spark, sf_dir))
    above = plan[: plan.index("Join ")]
    assert "Generate inline(" in above
    assert re.search(r"collect_list\(", plan)


def test_a_place_of_more_rows_than_a_list_holds(spark):
    left = spark.range(3 * joins.HELD + 5).select(F.col("id").alias("k"), F.lit(42.0).alias("lat"), F.lit(25.0).alias("lon"))
    right = left.limit(3).select("k", "lat", "lon")
    got = joins.radius_join(left, right, F.when(F.col("k") % 2 == 0, 1.0))
    assert sorted((r["k"], r["r_k"]) for r in got.collect()) == [(k, j) for k in range(0, 3 * joins.HELD + 5, 2) for j in range(3)]
    assert [n for (n,) in joins.listed(left, ["lat", "lon"]).select(F.size("held")).orderBy(F.size("held")).collect()] == [5, joins.HELD, joins.HELD, joins.HELD]


def test_labels_are_listed_once_for_places_that_share_a_spot_and_time(spark):
    ring = [[{"x": a, "y": 4_200_000 + b} for a, b in ((0, 0), (1000, 0), (1000, 1000), (0, 1000))]]
    rng = random.Random(3)
    held = [(k, ring, s, s + 500) for k in (7, 3, 5, 5, 9) for s in (rng.randrange(1000), rng.randrange(1000))]
    at = [(k, rng.choice([500, 1020, 90_000]), 4_200_500, rng.choice([*range(0, 1600, 7), held[0][2], held[1][3], None]), rng.choice([None, 10, 5, 3000])) for k in range(600)]
    places = spark.createDataFrame(at, "place long, x long, y long, at_s long, reach_m long")
    perimeters = spark.createDataFrame(held, "label long, rings array<array<struct<x: long, y: long>>>, start_s long, end_s long")
    got = {r["place"]: (r["verdict"], r["labels"]) for r in polygons.labelled(places, perimeters, 4, 10, 20).collect()}
    metres = 0.0002 * (81.936 - 1.3146 * (42.005 - 42.7)) * 1000  # from x 1020 to the side at 1000
    far = lambda x, reach: 0 if x == 500 else math.floor(metres + 0.5) if x == 1020 else 10**9
    want = {}
    for k, x, _, t, reach in at:
        own = sorted({h[0] for h in held if t is not None and h[2] - 10 <= t <= h[3] + 20 and far(x, reach) <= max(reach or 0, 4)})
        want[k] = ("ambiguous" if len(own) > 1 else "labeled" if own else "unlabeled", own)
    assert got == want and {v for v, _ in want.values()} == {"ambiguous", "labeled", "unlabeled"}


def test_detections_follow_lists_of_labels(spark, sf_dir):
    plan = plan_of(registry.queries()["jn_04_labelled_detections"](spark, sf_dir))
    assert "MapInArrow" in plan and not re.search(r"Aggregate \[place", plan)  # no labels are gathered by detection
