"""What grew faster than the input on larger tables, or differed from SQL there."""

import datetime as dt
import hashlib
import itertools
import math
import random
import re

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from emberline import params as p
from emberline import registry
from emberline.functions import rings
from emberline.operators import joins, lifecycle, mixture, polygons, scoring, tolerance, tracing
from emberline.plans import lifecycle as lifecycle_plans
from emberline.plans.catalog import frame, spark_sql
from emberline.streaming import pump


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_wind_from_due_east_has_the_sign_of_sql(spark, tmp_path):
    n = 14
    rows = {"event_id": list(range(n)), "user_id": [1] * n, "event_type": ["view"] * n, "ts": [dt.datetime(2024, 1, 1)] * n, "value": [200.0] * 7 + [200.25] * 7}
    pq.write_table(pa.table(rows), tmp_path / "events.parquet")
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
        want = sorted(c.execute(registry.oracle_sql()["geo_41_wind"]).fetchall())
    assert [tuple(r) for r in registry.queries()["geo_41_wind"](spark, str(tmp_path)).orderBy("event_id").collect()] == want
    assert want[5][1] == want[6][1] == -180


@pytest.mark.parametrize("name, size", [("add_13_events_after_cursor", 50), ("srt_07_change_page", 25)])
def test_a_page_ends_at_the_lowest_of_equal_seqs(spark, tmp_path, name, size):
    users = [b + 100 * a for b in range(5) for a in range(12)]  # a hundred users on and three fires later, seq is the same
    rows = [(u, dt.datetime(2024, 1, 1) + k * dt.timedelta(hours=7), (u * 7 + k) % 500 + 0.5) for u in users for k in range(40)]
    user, ts, value = zip(*rows)
    pq.write_table(pa.table({"event_id": list(range(len(rows))), "user_id": user, "event_type": ["view"] * len(rows), "ts": ts, "value": value}), tmp_path / "events.parquet")
    sql = registry.oracle_sql()[name]
    with duckdb.connect() as c:
        c.execute("SET TimeZone = 'UTC'")
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
        left_open = c.execute(sql).df()
        want, longer = (c.execute(sql.replace("ORDER BY seq LIMIT", "ORDER BY seq, fire_id LIMIT").replace(f"LIMIT {size}", f"LIMIT {n}")).df().sort_values("fire_id") for n in (size, size + 1))
    assert len(want) == size and longer["seq"].max() == want["seq"].max()  # the page is cut between equals
    got = registry.queries()[name](spark, str(tmp_path))
    assert [tuple(r) for r in got.select(*want.columns).orderBy("fire_id").collect()] == list(want.itertuples(index=False, name=None))
    assert sorted(want["seq"]) == sorted(left_open["seq"])  # what SQL leaves open is only which of the equals


def test_lags_are_counted_before_they_are_ranked(spark, sf_dir):
    for name in ("agg_23_availability_profile", "agg_26_nearest_rank"):
        plan = plan_of(registry.queries()[name](spark, sf_dir))
        assert "Aggregate" in plan[plan.rindex("Window") :], f"{name} ranks rows"


def test_a_cut_names_its_ring_once(spark):
    square = rings.clipped(F.col("ring"), F.col("b"))
    assert str(square).count("zip_with") <= 8
    df = spark.sql("SELECT array(struct(0L AS x, 0L AS y), struct(10L AS x, 0L AS y), struct(10L AS x, 10L AS y), struct(0L AS x, 10L AS y)) AS ring, struct(2L AS west, 3L AS south, 8L AS east, 9L AS north) AS b")
    assert {tuple(v) for v in df.select(square.alias("l")).first()["l"]} == {(2, 3), (8, 3), (8, 9), (2, 9)}
    assert df.select(rings.clipped(F.slice("ring", 1, 0), F.col("b")).alias("l")).first()["l"] == []


def test_ways_are_assembled_in_rows_not_groups(spark):
    ways = spark.sql("SELECT * FROM VALUES (1, 1, array(struct(1L AS x, 1L AS y), struct(0L AS x, 0L AS y))), (1, 0, array(struct(0L AS x, 0L AS y), struct(1L AS x, 0L AS y), struct(1L AS x, 1L AS y))), (2, 0, array(struct(0L AS x, 0L AS y), struct(1L AS x, 0L AS y))) AS t(key, place, way)")
    got = tracing.rings_of_ways(ways, "key")
    assert "FlatMapGroups" not in plan_of(got)
    assert {r["key"]: ([[tuple(v) for v in ring] for ring in r["rings"]], r["unclosed"]) for r in got.collect()} == {1: ([[(0, 0), (1, 0), (1, 1)]], 0), 2: ([], 1)}


def test_alike_polygons_are_measured_once(spark):
    ring = [[{"x": 2250000, "y": 4100000}, {"x": 2260000, "y": 4100000}, {"x": 2260000, "y": 4110000}]]
    df = spark.createDataFrame([(k, ring, 0, 10) for k in range(40)] + [(99, ring, 11, 12)], "key long, rings array<array<struct<x: long, y: long>>>, start_s long, end_s long")
    got = polygons.polygon_pairs(df, 2000)
    assert "Aggregate [shape" in plan_of(got)
    assert sorted((r["a"], r["b"], r["gap_m"]) for r in got.collect()) == [(a, b, 0) for a in range(40) for b in range(a + 1, 40)]


def test_events_of_neighbouring_numbers_share_a_state(spark, tmp_path):
    changes = spark.range(4000).selectExpr("id AS seq", "id % 500 AS event_id", "IF(id % 3 = 0, 'a', 'b') AS status", "IF(id % 7 = 0, 'feed', 'map') AS tier", "IF(id % 37 = 0, id, NULL) AS merged_into", "id % 29 = 0 AS invalidated")
    changes.write.parquet(f"{tmp_path}/changes")
    stream = pump.pump(spark, f"{tmp_path}/changes", str(tmp_path), 1500)
    try:
        stream.processAllAvailable()
        states = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in stream.recentProgress if p["stateOperators"]]
    finally:
        stream.stop()
    got = spark.read.schema(pump.FRAMES).parquet(f"{tmp_path}/frames")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, pump.frames(changes).select(*got.columns).collect()))
    assert max(states) <= 3


def test_rows_claim_in_order_without_pairs(spark):
    rng = random.Random(5)
    row = lambda uid: (uid, rng.choice((0, 1000, 5000)) + rng.randrange(0, 300), rng.randrange(0, 60), rng.randrange(-30, 30))
    missing, extra = [row(f"m{k}") for k in range(700)], [row(f"x{k}") for k in range(800)]
    missing += [(f"z{k:03}", 9000, 900, 900) for k in range(300)]  # the same first choice for all: a round for each, if it takes rounds
    extra += [(f"y{k:03}", 9000, 900, 900) for k in range(300)] + [(None, 9000, 900, 900), ("w", None, 900, 900)]
    left, want = [r for r in extra if None not in r], []
    for m in sorted(missing, key=lambda r: (r[1], r[0])):
        near = [(abs(r[1] - m[1]), max(abs(r[2] - m[2]), abs(r[3] - m[3])), r[0], r) for r in left]
        if near := [n for n in near if n[0] <= 40 and n[1] <= 7]:
            best = min(near)
            left.remove(best[3])
            want.append((m[0], best[2], best[3][1] - m[1], best[1]))
    schema = "uid string, acq_s long, lat_e5 long, lon_e5 long"
    got = tolerance.tolerance_pairs(spark.createDataFrame(missing, schema), spark.createDataFrame(extra, schema), 40, 7).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 600


def test_shares_are_worked_out_once(spark):
    shares = mixture.shares(F.col("w"), 10)
    assert str(shares).count("array_sort") == 1 and str(shares).count("aggregate") <= 4
    df = spark.sql("SELECT * FROM VALUES (array(1D, 1D, 1D, 0D)), (array(0D, 0D, 7D, 0D)), (array(0D, 0D, 0D, 0D)) AS t(w)")
    assert [r["s"] for r in df.select(shares.alias("s")).collect()] == [[4, 3, 3, 0], [0, 0, 10, 0], []]


def test_members_are_dealt_as_events_before_they_widen(spark, sf_dir):
    plan = frame(spark, sf_dir, "members")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("sha2") < plan.index("Exchange")


def test_events_fetch_evidence_without_being_gathered(spark, sf_dir):
    found = lifecycle_plans.evidence(spark, sf_dir)
    assert "Exchange hashpartitioning(event_id" not in found._jdf.queryExecution().executedPlan().toString()


def test_evidence_after_a_moment_is_that_of_each_pass(spark):
    looks = spark.createDataFrame([(r, s, t, ph, b) for r in (1, 2) for s, t, ph, b in [("modis", 10, "day", "clear"), ("viirs_snpp", 10, "night", "half"), ("modis", 30, "night", "blocked"), ("slstr", 40, "night", "clear"), ("modis", 50, "day", "frozen")]], "region long, source string, at_s long, phase string, band string")
    events = spark.createDataFrame([(t, 1, t) for t in (5, 10, 29, 30, 40, 60)], "event_id long, region long, last_s long")
    counted = ~F.col("verdict").isin(lifecycle.NO_CHANCE)
    each = lifecycle.pass_verdicts(events, looks).groupBy("event_id").agg(F.sum("weight_q").alias("q"), F.max((F.col("weight_q") > 0) & (F.col("phase") == "day")), F.max((F.col("weight_q") > 0) & (F.col("phase") == "night")), F.count_if(counted), F.max(F.when(counted, F.col("at_s"))))
    after = next(r["after"] for r in lifecycle.passes_after(looks).collect() if r["region"] == 1)
    for e, q, *rest in each.collect():
        at, got_q, *got = max(x for x in after if x["at_s"] <= e)
        assert (got_q or 0, *got) == (q, *rest)


def test_events_of_all_moments_come_from_one_pass(spark):
    rows = [(1, 5, 10, 100, 7.0), (1, 5, 20, 101, 3.0), (1, 21, 20, 102, 4.0), (1, 5, 20, 103, None), (2, 6, 25, 104, 1.0)]
    uid = {i: hashlib.sha256(str(i).encode()).hexdigest() for i in range(100, 105)}
    got = {r["event_id"]: r for r in lifecycle_plans.known(spark.createDataFrame(rows, "fire_id long, user_id long, acq_s long, event_id long, frp double"), [15, 22, 30]).collect()}
    for i, at in enumerate([15, 22, 30]):
        for fire in (1, 2):
            mine = sorted((r for r in rows if r[0] == fire and r[2] < at), key=lambda r: (r[2], uid[r[3]]))
            want = mine and (mine[-1][1] % 16, mine[-1][2], mine[-1][4], max(r[4] for r in mine if r[4] is not None))
            assert (got[fire][f"k{i}"] and tuple(got[fire][f"k{i}"])) == (want or None)


def test_what_is_owed_is_not_gathered_by_no_survivor(spark, sf_dir):
    plan = plan_of(registry.queries()["jn_17_owed_pairs"](spark, sf_dir))
    assert not [line for line in plan.splitlines() if "Join LeftAnti" in line and "merged_into" in line]


def test_the_fire_before_is_found_without_a_window_over_all(spark, sf_dir):
    for text in (lifecycle_plans._BEFORE_FOUND, lifecycle_plans._MERGES_FOUND):
        df = spark_sql(spark, sf_dir, text)
        assert not [line for line in plan_of(df).splitlines() if "Window" in line and "lag(fire_id" in line]
    plan = plan_of(lifecycle_plans.write_plan(spark, sf_dir))
    assert not [line for line in plan.splitlines() if "Window" in line and "lag(fire_id" in line]


def test_sets_are_dealt_by_key_once(spark, sf_dir):
    plan = registry.queries()["jn_28_jaccard_pairs"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "functions=[count(1)]" in plan and not [line for line in plan.splitlines() if "HashAggregate(keys=[key#" in line and "element#" not in line]
    assert not [line for line in plan.splitlines() if "Exchange" in line and "uid#" in line]


def test_rounds_of_matching_are_kept_as_tables(spark):
    pairs = spark.createDataFrame([(1, 1, 5), (1, 2, 4), (2, 1, 3), (2, 2, 1)], "l_key long, r_key long, common long")
    got = joins.mutual_matches(pairs, [F.desc("common")])
    assert got.inputFiles() and sorted((r["l_key"], r["r_key"]) for r in got.collect()) == [(1, 1), (2, 2)]


def test_overpasses_of_two_points_are_dropped_before_cells(spark):
    rng = random.Random(3)
    points = [(e, o, 4100000 + rng.randrange(3000), 2250000 + rng.randrange(3000)) for e in range(30) for o in "ab" for _ in range(rng.randrange(1, 9))]
    got = scoring.coherent(spark.createDataFrame(points, "fire_id long, overpass string, lat_e5 long, lon_e5 long"), "fire_id")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Filter .*_n#\d+L > ", plan[plan.rindex("Generate explode(sequence((r") :])
    km = lambda a, b: math.hypot((b[1] - a[1]) / 1e5 * (p.KM_LON + p.KM_LON_SLOPE * ((a[0] + b[0]) / 2e5 - p.REF_LAT)), (b[0] - a[0]) / 1e5 * p.KM_LAT)
    want = set()
    for e, o in {x[:2] for x in points}:
        own = {x[2:] for x in points if x[:2] == (e, o)}
        if any(max(km(*c) for c in itertools.combinations(three, 2)) <= p.COHERENT_KM for three in itertools.combinations(own, 3)):
            want.add(e)
    assert 3 < len(want) < 30 and {r["fire_id"] for r in got.collect()} == want
