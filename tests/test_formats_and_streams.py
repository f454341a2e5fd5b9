"""Readers, writers, clustering and streams on small inputs made here."""

import json
import random

import pytest
from pyspark.sql import functions as F

from emberline import params as p
from emberline.operators import clustering, graph
from emberline.sources import readers, sinks
from emberline.streaming import ingest, state

HEADER = "latitude,longitude,bright_ti4,scan,track,acq_date,acq_time,satellite,confidence,version,bright_ti5,frp,daynight"
GOOD = "42.12345,25.5,330.1,0.4,0.4,2024-01-02,931,N20,n,2.0,290.0,7.5,D"


def csv(tmp_path, *lines, header=HEADER):
    path = tmp_path / "in.csv"
    path.write_bytes("\r\n".join([header, *lines]).encode())
    return str(path)


def test_csv_rows_and_rejections(spark, tmp_path):
    rows = readers.active_fire_csv(spark, csv(tmp_path, GOOD, GOOD.replace("931", "2561"), GOOD.replace("42.12345", "x"), GOOD.replace(",n,", ",zz,"), header="﻿" + HEADER)).withColumn("available_s", F.lit(1704190000))
    good, bad = readers.parsed(rows, "viirs_noaa20")
    assert bad.count() == 3
    r = good.first()
    assert (r["acq_s"], r["lat_e5"], r["lon_e5"], r["confidence"], len(r["uid"])) == (1704187860, 4212345, 2550000, "nominal", 64)
    with pytest.raises(ValueError, match="frp"):
        readers.active_fire_csv(spark, csv(tmp_path, GOOD, header=HEADER.replace("frp", "power")))


def test_json_xml_and_tsv(spark, tmp_path):
    (tmp_path / "index").write_text('{"levtype":"sfc","step":"3","param":"10u","_offset":5,"_length":7}\nrubbish\n{"levtype":"sfc","step":"3","param":"10u","_offset":9,"_length":9}\n{"levtype":"pl","step":"3","param":"10v","_offset":1,"_length":1}\n')
    assert [tuple(r) for r in readers.index_lines(spark, str(tmp_path / "index"), "3", ["10u", "10v"]).collect()] == [("10u", 5, 7)]
    (tmp_path / "feed.xml").write_text("<feed><entry><id>a</id><title>T &amp; U</title><updated>2024-01-02T03:04:05Z</updated></entry><entry><title>no id</title></entry></feed>")
    assert [(r["id"], r["title"], r["usable"]) for r in readers.atom_feed(spark, str(tmp_path / "feed.xml")).collect()] == [("a", "T & U", True), (None, "no id", False)]
    (tmp_path / "no.xml").write_text("<html><entry/></html>")
    assert readers.atom_feed(spark, str(tmp_path / "no.xml")).count() == 0
    (tmp_path / "cap.xml").write_text("<alert><identifier>i</identifier><info><language>en</language><event>fire</event><severity>Severe</severity><expires>2024-01-02T03:04:05Z</expires><area><areaDesc>A</areaDesc></area><area><areaDesc>B</areaDesc></area></info></alert>")
    assert sorted((r["severity"], r["area"]) for r in readers.cap_alerts(spark, str(tmp_path / "cap.xml")).collect()) == [("Severe", "A"), ("Severe", "B")]
    (tmp_path / "list.json").write_text(json.dumps({"results": [{"code": "E1", "category": "fire", "centroid": "POINT(25.1 42.2)", "extent": "POLYGON((25 42, 26.00001 42, 26 43, 25 42))"}, {"code": "E2", "centroid": "POINT(x)"}]}))
    got = {r["code"]: r for r in readers.activations(spark, str(tmp_path / "list.json")).collect()}
    assert (got["E1"]["lon"], got["E1"]["box"]["east"], got["E2"]["lon"]) == (25.1, 26.0001, None)
    (tmp_path / "poll-01.json").write_text(json.dumps({"availableAt": "t0", "detections": [{"detectionUid": "u"}, {"detectionUid": "v", "availableAt": "t1"}]}))
    assert [(r["detectionUid"], r["available_at"]) for r in readers.replay_batches(spark, str(tmp_path / "poll-01.json")).collect()] == [("u", "t0"), ("v", "t1")]
    (tmp_path / "p.tsv").write_text("7\tSofia\tSofia\t\t42.7\t23.3" + "\t" * 8 + "\t1000\n")
    assert tuple(readers.places_tsv(spark, str(tmp_path / "p.tsv")).first()) == (7, "Sofia", 42.7, 23.3, 1000)


def test_perimeter_rejects(spark):
    ok = {"properties": {"id": "a", "area_ha": 5.0, "firedate": "2024-01-02 00:00:00", "lastupdate": "2024-01-03 00:00:00"}, "geometry": {"type": "Polygon", "coordinates": [[[1.0, 2.0], [3.0, 4.0], [1.0, 2.0]]]}}
    vary = lambda **k: {"properties": ok["properties"] | k, "geometry": ok["geometry"]}
    features = [ok, vary(lastupdate="2024-01-04 00:00:00"), vary(id=None), vary(id="b", area_ha=0), vary(id="c", firedate="?"), {"properties": ok["properties"] | {"id": "d"}, "geometry": {"type": "Point"}}]
    got = readers.perimeters(spark.createDataFrame([(json.dumps(f),) for f in features], "feature string"))
    assert sorted((r["reject"] or "") for r in got.collect()) == ["", "bad_date", "duplicate_id", "no_area", "no_id", "no_polygon"]


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([(1, "=a,b", 25.5, 42.25)], "id int, name string, lon double, lat double")
    assert json.loads(sinks.geojson_lines(e, ["name", "id"]).first()["line"]) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [25.5, 42.25]}, "properties": {"id": 1, "name": "=a,b"}}
    assert sinks.csv_lines(e, ["id", "name"]).first()["line"] == "1,\"'=a,b\""
    assert "<coordinates>25.50000,42.25000" in sinks.kml_lines(e, "name", "id").first()["line"]
    s = spark.createDataFrame([("f", "h", "gauge", {"b": 'x"', "a": "1"}, 2.0), ("f", "h", "gauge", {}, 1.0)], "family string, help string, kind string, labels map<string,string>, value double")
    assert [r["line"] for r in sinks.exposition_lines(s).collect()] == ["# HELP f h", "# TYPE f gauge", "f 1.0", 'f{a="1",b="x\\""} 2.0']
    where = str(tmp_path / "t")
    rows = lambda *x: spark.createDataFrame(x, "month string, uid string, v int")
    assert sinks.promote(rows(("1", "a", 1), ("2", "b", 1)), where, "month")["promoted"]
    assert not sinks.promote(rows(("2", "c", 2), ("2", "c", 3)), where, "month")["promoted"]
    assert sinks.promote(rows(("2", "c", 2)), where, "month")["promoted"]
    assert sorted((r["uid"], r["v"]) for r in spark.read.parquet(where).collect()) == [("a", 1), ("c", 2)]
    held, new = spark.createDataFrame([(1, 5, 5), (2, 6, 6)], "k int, s int, v int"), spark.createDataFrame([(1, None, None), (3, 7, 7)], "k int, s int, v int")
    assert sorted(tuple(r) for r in sinks.upserted(held, new, ["k"], ["s"]).collect()) == [(1, 5, None), (2, 6, 6), (3, 7, 7)]


def naive(rows):
    """The same rules over all clusters at once, in arrival order."""
    clusters, of = {}, {}
    for uid, src, acq, now, lat, lon in sorted(rows, key=lambda r: (r[3], r[1], round(r[4] * 1e5), round(r[5] * 1e5), r[0])):
        clusters = {k: c for k, c in clusters.items() if now - c["last"] <= p.ACTIVE_H * 3600}
        coarse, bound = src in p.ATTACH_ONLY, round(p.EPS_KM[src] * 1e6)
        near = {}
        for k, c in clusters.items():
            if max(c["start"] - acq, acq - c["last"], 0) <= p.T_LINK_H * 3600:
                q = min(clustering._quanta(a, b, lat, lon) for a, b in c["points"])
                if q <= bound:
                    near[k] = q
        if not near:
            of[uid] = None if coarse else uid
            if not coarse:
                clusters[uid] = {"start": acq, "last": acq, "n": 1, "points": [(lat, lon)]}
            continue
        own = min(near, key=lambda k: (near[k], k)) if coarse else min(near, key=lambda k: (clusters[k]["start"], -clusters[k]["n"], k))
        if not coarse:
            for k in near:
                if k != own:
                    g, c = clusters.pop(k), clusters[own]
                    c.update(start=min(c["start"], g["start"]), last=max(c["last"], g["last"]), n=c["n"] + g["n"], points=c["points"] + g["points"])
                    of = {u: own if v == k else v for u, v in of.items()}
        c = clusters[own]
        c.update(start=min(c["start"], acq), last=max(c["last"], acq), n=c["n"] + 1, points=[*c["points"], (lat, lon)])
        of[uid] = own
    return of


def test_clustering_equals_the_naive_engine(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        acq = 1704067200 + rng.randrange(20 * 24) * 3600
        lat, lon = (round(x, 5) for x in (42 + rng.choice((0, 0.4, 1.1)) + rng.random() * 0.08, 25 + rng.random() * 0.1))
        rows.append((f"u{i:03d}", rng.choice(("viirs_snpp", "viirs_noaa20", "slstr", "geo_msg")), acq, acq + rng.randrange(5) * 7200, lat, lon))
    d = spark.createDataFrame(rows, "uid string, source string, acq_s long, available_s long, lat double, lon double")
    d = d.withColumns({"lat_e5": F.round(F.col("lat") * 1e5).cast("long"), "lon_e5": F.round(F.col("lon") * 1e5).cast("long"), "scan_km": F.lit(0.5), "track_km": F.lit(0.5)})
    got = {r["uid"]: r["cluster"] for r in clustering.clustered(d.unionAll(d.limit(20))).collect()}
    assert got == naive(rows)
    assert len(set(got.values())) < 300
    assert clustering.clustered(d.limit(0)).count() == 0


def test_components(spark):
    nodes = spark.range(10).select(F.col("id").alias("node"))
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 5), (5, 2), (8, 9), (9, 8)], "a long, b long")
    assert {r["node"]: r["root"] for r in graph.smallest_reachable(nodes, edges).collect()} == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4, 5: 1, 6: 6, 7: 7, 8: 8, 9: 8}


def test_ingest_stream_is_idempotent(spark, tmp_path):
    landing, where = tmp_path / "landing", str(tmp_path / "out")
    landing.mkdir()
    now = __import__("datetime").datetime.now(__import__("datetime").UTC)
    today = (now - __import__("datetime").timedelta(hours=2)).strftime("%Y-%m-%d,%H%M")
    line = GOOD.replace("2024-01-02,931", today)
    (landing / "a.csv").write_text("\n".join([HEADER, line, line, line.replace("7.5", "-3")]))
    ingest.ingest_stream(spark, str(landing), where, "viirs_noaa20").awaitTermination()
    (landing / "b.csv").write_text("\n".join([HEADER, line, line.replace("25.5,", "25.6,")]))
    ingest.ingest_stream(spark, str(landing), where, "viirs_noaa20").awaitTermination()
    assert spark.read.parquet(f"{where}/archive").count() == 2
    assert spark.read.parquet(f"{where}/quarantine").select(F.explode("violations")).distinct().count() >= 1
    assert spark.read.parquet(f"{where}/ledger").agg(F.sum("rows")).first()[0] == 5
    again = spark.read.schema(readers.CSV_COLUMNS).option("header", True).csv(str(landing / "b.csv")).withColumn("available_s", F.lit(int(now.timestamp())))
    ingest.ingest_batch(again, 1, where, "viirs_noaa20")
    assert spark.read.parquet(f"{where}/archive").count() == 2


def test_states_hold_across_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("k", 0, True), ("k", 200, True)], "key string, at_s long, bad boolean").coalesce(1).write.parquet(str(tmp_path / "in/1"))

    def run():
        s = spark.readStream.schema("key string, at_s long, bad boolean").parquet(str(tmp_path / "in/*"))
        q = state.demotions(s).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    spark.createDataFrame([("k", 300, True), ("k", 400, False), ("k", 2300, False)], "key string, at_s long, bad boolean").coalesce(1).write.parquet(str(tmp_path / "in/2"))
    run()
    assert {r["at_s"]: r["mode"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {0: "full", 200: "full", 300: "reduced", 400: "reduced", 2300: "full"}
    now, allowed = (-1, 0), []
    for t in (5, 6, 7, 64, 65, 66):
        now, ok = state.limiter_step(now, t, 2, 60)
        allowed.append(ok)
    assert allowed == [True, True, False, False, True, True]
    batch = spark.createDataFrame([("a", 1, 5), ("a", 3, 7), ("b", 2, 1), ("a", 2, 6)], "key string, seq long, v int")
    assert sorted((r["key"], r["seq"], r["row"]["v"]) for r in ingest.latest_by_seq(batch).collect()) == [("a", 3, 7), ("b", 2, 1)]
