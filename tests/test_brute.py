"""Queries that SQL doesn't say, against plain loops over the whole small tables."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_formats_and_streams import naive

from emberline import registry
from emberline.functions import parsing
from emberline.operators import alerts, clustering, joins, outline, polygons, tracing
from emberline.plans import small
from emberline.plans.catalog import _register, frame


def test_tolerance_pairs(spark, sf_dir):
    missing, extra = ([r.asDict() for r in df.collect()] for df in small.near_misses(spark, sf_dir))
    near, left, want = defaultdict(list), {r["uid"] for r in extra}, set()
    for r in extra:
        near[r["acq_s"] // 43200].append(r)
    for m in sorted(missing, key=lambda r: (r["acq_s"], r["uid"])):
        found = []
        for k in (-1, 0, 1):
            for r in near[m["acq_s"] // 43200 + k]:
                dt, dx = abs(r["acq_s"] - m["acq_s"]), max(abs(r["lat_e5"] - m["lat_e5"]), abs(r["lon_e5"] - m["lon_e5"]))
                if r["uid"] in left and dt <= 43200 and dx <= 1000:
                    found.append((dt, dx, r["uid"]))
        if found:
            left.discard(min(found)[2])
            want.add((m["uid"], min(found)[2]))
    got = registry.queries()["jn_30_tolerance_pairs"](spark, sf_dir).collect()
    assert {(r["l_key"], r["r_key"]) for r in got} == want and len(got) == len(want) > 100


def test_crc32(spark, sf_dir):
    got = registry.queries()["agg_52_crc32"](spark, sf_dir).collect()
    assert got and len(got[0]) >= 2
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    if "doc_id" in got[0].asDict():
        other = next(c for c in got[0].asDict() if c != "doc_id")
        assert {r["doc_id"]: r[other] for r in got} == {d: zlib.crc32((t or "").encode()) for d, t in texts.items()}


def test_hulls(spark, sf_dir):
    points = defaultdict(set)
    for r in frame(spark, sf_dir, "members").select("fire_id", "lat_e5", "lon_e5").collect():
        points[r["fire_id"]].add((r["lat_e5"], r["lon_e5"]))

    def corners(own):
        """Places that lie on no segment between others and in no triangle of others: those with a line that has all others strictly on one side."""
        if len(own) < 3:
            return len(own)
        turn = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        if all(turn(*list(own)[:2], c) == 0 for c in own):
            return 2
        found = set()
        for a in own:
            for b in own:
                if a != b and all(turn(a, b, c) > 0 or (turn(a, b, c) == 0 and min(a, b) <= c <= max(a, b)) for c in own):
                    found |= {a, b}
        return len(found)

    got = {r["fire_id"]: r["corners"] for r in registry.queries()["agg_05_hulls"](spark, sf_dir).collect()}
    assert got == {k: corners(v) for k, v in points.items()}


def test_names_are_registered_once():
    name = next(iter(registry.queries()))
    with pytest.raises(ValueError, match="twice"):
        _register(name, lambda spark, sf_dir: None)


def test_polygon_edges(spark):
    """Places on sides, at corners and in holes, polygons of one vertex, and places that no polygon is near."""
    square, hole = [(0, 0), (100_000, 0), (100_000, 100_000), (0, 100_000)], [(40_000, 40_000), (60_000, 40_000), (60_000, 60_000), (40_000, 60_000)]
    rows = [(1, [[{"x": x, "y": y} for x, y in ring] for ring in (square, hole)]), (2, [[{"x": 300_000, "y": 300_000}]])]
    regions = spark.createDataFrame(rows, "region long, rings array<array<struct<x: long, y: long>>>")
    places = spark.createDataFrame([(1, 50_000, 30_000), (2, 50_000, 50_000), (3, 100_500, 50_000), (4, 300_100, 300_000), (5, 900_000, 900_000), (6, 41_000, 50_000)], "place long, x long, y long")
    assert {r["place"]: r["region"] for r in polygons.region_of(places, regions, 2000).collect()} == {1: 1, 2: None, 3: 1, 4: 2, 5: None, 6: 1}
    assert polygons.region_of(places.limit(0), regions, 2000).collect() == [] and {r["region"] for r in polygons.region_of(places, regions.limit(0), 2000).collect()} == {None}


def test_series_keeps_so_many_points(spark):
    rows = [(1, f"{k:03}", k * 10_000, 4_200_000 + k * 500, 2_300_000) for k in range(100)]
    got = outline.series(spark.createDataFrame(rows, "fire_id long, uid string, acq_s long, lat_e5 long, lon_e5 long"), "fire_id").collect()
    assert sorted(r["at_s"] for r in got) == [(k * 99 // 47) * 10_000 for k in range(48)]
    assert [r["cells"] for r in sorted(got, key=lambda r: r["at_s"])] == sorted(r["cells"] for r in got)


@pytest.mark.parametrize(("typed", "want"), [
    ("42.69, 23.32", (42.69, 23.32)), ("42,69 23,32", (42.69, 23.32)), ("−1.5;170", (-1.5, 170)), ("120 45", (45, 120)), ("42°41'N 23°19'E", (42 + 41 / 60, 23 + 19 / 60)),
    ("23°19'12\" з, 42° с", (42, -23.32)), ("42N 43N", None), ("42°70'N 23°E", None), ("somewhere", None), ("", None), ("100 200", None),
])
def test_coordinates(spark, typed, want):
    at = spark.createDataFrame([(typed,)], "t string").select(parsing.coordinates(F.col("t")).alias("at")).first()["at"]
    assert (at and (at["lat"], at["lon"])) == (want and pytest.approx(want))


def test_small_texts(spark):
    row = spark.range(1).select(
        parsing.path_segment(F.lit("..a b")).alias("path"), parsing.path_segment(F.lit("")).alias("none"), parsing.is_public_v4(F.lit("8.8.8.8")).alias("p"), parsing.is_public_v4(F.lit("010.1.1.1")).alias("q"),
        parsing.fragment(F.lit("#a=1&b&a=2&c=x=y")).alias("m"), parsing.quantized_shares(F.array(F.lit(0).cast("long"), F.lit(0).cast("long")), 10).alias("s"), parsing.hilbert_id(F.lit(0), F.lit(0), F.lit(0)).alias("h"), parsing.fnv_hex(F.lit("")).alias("f"),
    ).first()
    assert (row["path"], row["none"], row["p"], row["q"], row["m"], row["s"], row["h"], row["f"]) == ("~2e.a~20b", "", True, False, {"a": "1", "c": "x=y"}, [], 0, "811c9dc5")


def test_unknown_conditions_do_not_decide(spark):
    columns = "zone_id long, account_id long, fire_id long, quarantined boolean, invalidated boolean, non_geo long, n long, night_high long, score double, min_score double, notified_s long, started_s long, created_s long, step int, last_step int, zone_notified_s long, last_s long, quiet boolean, metres long"
    got = alerts.decided(spark.createDataFrame([(1, 1, 1, *[None] * 15, 5), (2, 1, 1, *[None] * 15, 5)], columns), 100)
    rows = alerts.one_zone_an_account(got).collect()
    assert {r["decision"] for r in rows} == {"send:clear"} and sorted((r["zone_id"], r["sends"]) for r in rows) == [(1, True), (2, False)]


def test_stable_matching_of_two_orders(spark):
    """Left rows that choose in turn: the first takes what it likes best, the others what is left."""
    pairs = [(a, b, a, (a * 7 + b * 5) % 11) for a in range(12) for b in range(9)]
    left, want = set(range(9)), []
    for a in range(12):
        mine = [(w, b) for x, b, _, w in pairs if x == a and b in left]
        if mine:
            left.discard(min(mine)[1])
            want.append((a, min(mine)[1]))
    got = joins.mutual_matches(spark.createDataFrame(pairs, "l_key long, r_key long, turn long, w long"), [F.col("w"), F.col("r_key")], [F.col("turn")])
    assert sorted((r["l_key"], r["r_key"]) for r in got.collect()) == want


def test_clustering_is_cut_at_silences(spark):
    """Seasons months apart, with late arrivals: as many clusters as the naive engine finds, in several stretches."""
    rng, rows = random.Random(9), []
    for i in range(240):
        acq = 1704067200 + (i % 3) * 40 * 86400 + rng.randrange(6 * 24) * 3600
        late = rng.choice((0, 0, 0, 50 * 3600))
        rows.append((f"u{i:03d}", rng.choice(("viirs_snpp", "slstr", "geo_msg")), acq, acq + late, round(42 + rng.random() * 0.05, 5), round(25 + rng.random() * 0.05, 5)))
    d = spark.createDataFrame(rows, "uid string, source string, acq_s long, available_s long, lat double, lon double")
    d = d.withColumns({"lat_e5": F.round(F.col("lat") * 1e5).cast("long"), "lon_e5": F.round(F.col("lon") * 1e5).cast("long"), "scan_km": F.lit(0.5), "track_km": F.lit(0.5)})
    assert clustering.stretches(d.withColumn("component", F.lit(1))).select("stretch").distinct().count() == 3
    assert {r["uid"]: r["cluster"] for r in clustering.clustered(d).collect()} == naive(rows)


def test_jaccard_pairs(spark):
    rng = random.Random(3)
    sets = {s: {k: {rng.choice([rng.randrange(12), rng.randrange(400)]) for _ in range(rng.randint(1, 12))} for k in range(60)} for s in "lr"}
    sets["r"] |= {k: set(v) for k, v in list(sets["l"].items())[:20]}
    rows = {s: spark.createDataFrame([(k, e) for k, v in own.items() for e in v for _ in range(2)], "key long, element long") for s, own in sets.items()}
    for least in (0.2, 0.5, 0.8, 1.0):
        got = {(r["l_key"], r["r_key"]): (r["common"], r["united"]) for r in joins.jaccard_pairs(rows["l"], rows["r"], least).collect()}
        want = {(a, b): (len(x & y), len(x | y)) for a, x in sets["l"].items() for b, y in sets["r"].items() if len(x & y) >= least * len(x | y)}
        assert got == want and len(want) >= 20


def test_traced_rings():
    """Areas and borders of the rings are those of the cells, whatever holes and corners these have; what is simplified lies close."""
    rng = np.random.default_rng(1)
    for _ in range(200):
        grid = rng.random((rng.integers(1, 9), rng.integers(1, 9))) < rng.choice([0.3, 0.6, 0.9])
        full = tracing.without_holes(grid)
        assert (full | grid == full).all() and (tracing.without_holes(full) == full).all()
        rings, padded = tracing.traced(full), np.pad(full, 1)
        area = lambda ring: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
        assert sum(map(area, rings)) == 2 * full.sum()
        assert sum(map(len, rings)) == sum((padded & ~np.roll(padded, s, (0, 1))).sum() for s in ((1, 0), (-1, 0), (0, 1), (0, -1)))
        for ring in rings:
            assert area(tracing.simplified(ring, 0.0)) == area(ring)
            thin = tracing.simplified(ring, 1.0)
            for x, y in ring:
                assert min(segment(x, y, a, b) for a, b in zip(thin, thin[1:] + thin[:1], strict=True)) <= 1.0 + 1e-9


def segment(x, y, a, b):
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = max(0.0, min(1.0, ((x - a[0]) * dx + (y - a[1]) * dy) / ((dx * dx + dy * dy) or 1)))
    return ((x - a[0] - t * dx) ** 2 + (y - a[1] - t * dy) ** 2) ** 0.5
