"""Joins and matchings over whole inputs, against plain loops."""

from pyspark.sql import functions as F

from emberline import registry
from emberline.operators import joins
from emberline.plans.catalog import frame


def greedy(pairs):
    lefts, rights, out = set(), set(), []
    for l, r, w in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if l not in lefts and r not in rights:
            lefts.add(l)
            rights.add(r)
            out.append((l, r))
    return sorted(out)


def test_greedy_matching_of_a_long_chain(spark):
    chain = [(k // 2, (k + 1) // 2, 1000 - k) for k in range(105)]  # 53 rounds: each claims one pair of the chain
    pairs = chain + [(500, 500, 7), (500, 500, 7), (500, 501, 7), (501, 500, 7), (501, 501, 6)]
    df = spark.createDataFrame(pairs, "l_key long, r_key long, w long").coalesce(1)
    got = joins.mutual_matches(df, [F.desc("w")])
    assert sorted((r["l_key"], r["r_key"]) for r in got.collect()) == greedy(pairs)


def test_joins_cover_all_zones_and_fires(spark, sf_dir):
    queries = registry.queries()
    zones = {r["zone_id"]: r for r in frame(spark, sf_dir, "zones").collect()}
    fires = {r["fire_id"]: r for r in frame(spark, sf_dir, "fires").collect()}
    near = {(z, f) for z, a in zones.items() for f, b in fires.items() if abs(a["lat_e5"] - b["lat_e5"]) < 15000 and abs(a["lon_e5"] - b["lon_e5"]) < 20000}
    got = {(r["zone_id"], r["fire_id"]) for r in queries["str_15_alert_decision"](spark, sf_dir).collect()}
    assert got == near
    d = {r["event_id"] for r in frame(spark, sf_dir, "detections").select("event_id").collect()}
    assert {r["event_id"] for r in queries["jn_38_bracket_join"](spark, sf_dir).collect()} == d
    for name in ("jn_24_event_chain", "jn_26_resolve_alias"):
        want = {r["alias"] for r in frame(spark, sf_dir, "aliases").select("alias").collect()}
        assert {r["alias"] for r in queries[f"{name}"](spark, sf_dir).collect()} == want
