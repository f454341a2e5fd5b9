"""Rows that share a place meet others once for all of them, and nothing that is repeated by cell is broadcast."""

import re

from pyspark.sql import functions as F

from emberline.operators import joins, outline, polygons
from emberline.plans import catalog
from emberline.plans.places import hull, hulls


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_places_meet_once(spark):
    left = spark.range(300).select(F.col("id").alias("k"), (F.lit(42.0) + F.col("id") % 3 * 0.01).alias("lat"), F.lit(25.0).alias("lon"))
    right = spark.range(500).select(F.col("id").alias("k"), F.lit(42.0).alias("lat"), (F.lit(25.0) + F.col("id") % 5 * 0.01).alias("lon"))
    near = joins.near_places(left, right, F.lit(50.0))
    assert near.count() == 3 * 5 and near.select("lat", "lon", "r_lat", "r_lon").distinct().count() == 15
    pairs = joins.radius_join(left, right, F.when(F.col("k") % 2 == 0, 50.0).otherwise(0.1))
    assert pairs.filter("k % 2 = 0").count() == 150 * 500
    assert {(r["k"] % 3, r["r_k"] % 5) for r in pairs.filter("k % 2 = 1").collect()} == {(0, 0)}
    assert "Broadcast" not in plan(pairs) and "Broadcast" not in plan(near)


def test_nearest_of_many_at_one_place(spark):
    left = spark.createDataFrame([(1, 42.0, 25.0), (2, 42.0, 25.0), (3, 45.0, 25.0)], "k long, lat double, lon double")
    right = spark.createDataFrame([(9, 42.0, 25.01, 0), (7, 42.0, 25.01, 0), (3, 42.02, 25.0, 0), (8, 42.0, 25.02, -1)], "site long, lat double, lon double, r int")
    assert sorted((r["k"], r["r_key"]) for r in joins.nearest(left, right, "site", 5.0).collect()) == [(1, 7), (2, 7)]
    assert sorted((r["k"], r["r_key"]) for r in joins.nearest(left, right, "site", 5.0, rank=F.col("r")).collect()) == [(1, 8), (2, 8)]


def test_parents_at_one_place_and_second(spark):
    day = 86400
    rows = [(1, 42.0, 25.0, 0, day), (2, 42.0, 25.0, 0, day), (3, 42.0, 25.0, -5, day), (4, 42.0, 25.0, 10 * day, 11 * day), (5, 42.0, 25.0, 10 * day, 12 * day), (6, 42.0, 25.001, 2 * day, 3 * day)]
    fires = spark.createDataFrame(rows, "fire_id long, lat double, lon double, started_s long, last_s long")
    got = {r["child"]: (r["parent"], r["gap_s"], r["km_q"]) for r in joins.reignitions(fires, fires, F.lit(14 * day), 11.0).collect()}
    assert got == {4: (3, 9 * day, 0), 5: (3, 9 * day, 0)}
    assert sorted(r["fire_id"] for r in joins.followed(fires, 11.0, 2 * day, 21 * day).collect()) == [1, 2, 3, 6]


def test_near_pairs_at_the_bounds(spark):
    rows = [(k, k, 42.0 + k % 7 * 0.009, 25.0 + k % 5 * 0.012, k * 997 % 30000 - 9000) for k in range(200)]
    got = {(r["a"], r["b"]) for r in joins.near_pairs(spark.createDataFrame(rows, "k long, g long, lat double, lon double, acq_s long"), "k", "g", 2.0, 7200).collect()}
    km = lambda a, b: (((b[3] - a[3]) * (81.936 - 1.3146 * ((a[2] + b[2]) / 2 - 42.7))) ** 2 + ((b[2] - a[2]) * 111.085) ** 2) ** 0.5
    assert got == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and abs(a[4] - b[4]) <= 7200 and km(a, b) <= 2.0}


def test_flashes_of_one_second_are_counted(spark):
    events = spark.createDataFrame([(1, 42.0, 25.0, 20000), (2, 42.0, 25.0, 20000), (3, 44.0, 25.0, 20000)], "fire_id long, lat double, lon double, started_s long")
    flashes = spark.createDataFrame([(42.0, 25.01, 19000)] * 3 + [(42.0, 25.02, 12000), (42.0, 25.0, 20001)], "lat double, lon double, t_s long")
    got = {r["fire_id"]: r["flashes"] for r in joins.flash_context(events, flashes).collect()}
    assert got == {1: 4, 2: 4, 3: 0}


def test_pairs_of_zones_and_fires_are_not_ordered(spark, sf_dir):
    """Windows and joins by account work on places, so no step sorts or shuffles all pairs; and no repeated side is broadcast."""
    for name in ("win_10_notifying_zone", "str_23_account_decisions", "str_15_alert_decision", "jn_10_box_candidates", "udf_21_decision_traces", "str_15_sending_zones"):
        text = plan(catalog.QUERIES[name](spark, sf_dir))
        last = text[: re.search(r"SortMergeJoin \[zy", text).start()]  # above the join of pairs there is no other step
        assert not re.search("Window|Exchange|Join|Sort", last), name


def test_shapes_are_shared(spark):
    rows = [(k, 4100000 + k * 200 + i * 350, 2250100 - k * 400 + i % 2 * 700) for k in range(50) for i in range(4)] + [(99, 4100050, 2250000)]
    d = spark.createDataFrame(rows, "fire_id long, lat_e5 long, lon_e5 long")
    keys, places = outline.shapes(d, "fire_id")
    assert keys.count() == 51 and keys.select("shape").distinct().count() == 2 and places.count() == 5
    got = {r["fire_id"]: (r["cells"], r["edges"]) for r in outline.areas(d, "fire_id").collect()}
    assert got == {r["fire_id"]: (r["cells"], r["edges"]) for r in outline._areas(d, "fire_id").collect()} and len(got) == 51


def test_hulls_of_small_and_large_groups(spark):
    rows = [(1, x * 7 % 101, x * 13 % 97) for x in range(5000)] + [(k, 1000 * k + a, 500 * k + b) for k in range(2, 40) for a, b in ((0, 0), (9, 0), (9, 9), (0, 9), (4, 4))]
    got = {r["fire_id"]: [(c["lat_e5"], c["lon_e5"]) for c in r["corners"]] for r in hulls(spark.createDataFrame(rows, "fire_id long, lat_e5 long, lon_e5 long"), "fire_id").collect()}
    assert got == {k: hull([(a, b) for f, a, b in rows if f == k]) for k in {r[0] for r in rows}}


def test_chains_hold_more_rows_than_a_recursive_statement(spark):
    n = 400_000  # with three steps more than the million rows at which a recursive statement ends
    links = spark.range(n).select(F.col("id").alias("alias"), F.when(F.col("id") % 4 > 0, F.col("id") - 1).alias("merged_into"))
    got = {r["depth"]: r["n"] for r in joins.chains(links, "alias", "merged_into", 8).groupBy("depth").agg(F.count("*").alias("n")).collect()}
    assert got == {0: n, 1: n * 3 // 4, 2: n // 2, 3: n // 4}


def test_same_spots_and_same_polygons(spark):
    square = [[(0, 0), (1000, 0), (1000, 1000), (0, 1000)]]
    ring = "rings array<array<struct<x: long, y: long>>>"
    at = spark.createDataFrame([(k, 500, 4200000 + 500) for k in range(3)] + [(9, 900000, 4200000)], "place long, x long, y long")
    moved = [[(x, y + 4200000) for x, y in square[0]]]
    sources = spark.createDataFrame([(4, moved), (2, moved)], f"source long, {ring}")
    got = {r["place"]: [s["source"] for s in r["sources"]] for r in polygons.sources_within(at, sources, 1500).collect()}
    assert got == {0: [2, 4], 1: [2, 4], 2: [2, 4]}
    positions = at.select((F.col("place") % 2).alias("key"), "x", "y")
    rows = polygons.site_relation(positions, sources.withColumnRenamed("source", "site"), 1500).collect()
    assert sorted((r["key"], r["site"], r["relation"], r["positions"], r["metres"]) for r in rows) == [(0, 2, "inside", 2, 0), (1, 2, "inside", 1, 0)]
    counted = polygons.class_counts(at.select("x", "y", F.lit(1).alias("class")), sources.withColumnRenamed("source", "key"))
    assert sorted((r["key"], r["class"], r["pixels"]) for r in counted.collect()) == [(2, 1, 3), (4, 1, 3)]
    assert "BroadcastHashJoin" not in plan(polygons.near_polygons(at, sources, 1500))
    pairs = polygons.shared_pairs(at, sources.withColumnRenamed("source", "key"), 1500)
    assert sorted((r["place"], r["key"], r["inside"], r["metres"]) for r in pairs.collect()) == [(p, k, True, 0) for p in range(3) for k in (2, 4)]
