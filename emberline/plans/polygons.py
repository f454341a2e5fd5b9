"""Queries of polygons: perimeters, regions with holes, sites, static sources and pixels, many of each in a table.

The SQL beside them tests every place against the sides of every polygon whose box is near.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline import params as p
from emberline.functions import rings as r
from emberline.operators import ingest, polygons
from emberline.plans.catalog import frame, query
from emberline.plans.relational import DAY

#: Vertices around a centre, in hundredths of the radius; and a hole that every fourth one has.
OUTER = [(-90, -60), (0, -30), (90, -70), (60, 20), (95, 90), (0, 40), (-80, 85)]
HOLE = [(-20, -20), (20, -20), (20, 20), (-20, 20)]
#: Hundred-thousandths of a degree for a hundredth of a kilometre.
UNIT = 9


def _ring(x: Column, y: Column, scale: Column, shape: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct((x + a * scale).cast("long").alias("x"), (y + b * scale).cast("long").alias("y")) for a, b in shape])


def _shaped(rows: DataFrame, x: Column, y: Column, scale: Column, holed: Column) -> DataFrame:
    outer = _ring(x, y, scale, OUTER)
    return rows.withColumn("rings", F.when(holed, F.array(outer, _ring(x, y, scale, HOLE))).otherwise(F.array(outer)))


def _sides(name: str, source: str, key: str, x: str, y: str, scale: str, holed: str) -> str:
    """SQL: the sides (key, ring, k, ax, ay, cx, cy) of the polygons."""
    rows = [(ring, k, *a, *b) for ring, shape in enumerate((OUTER, HOLE)) for k, (a, b) in enumerate(zip(shape, shape[1:] + shape[:1], strict=True))]
    values = ", ".join(str(row) for row in rows)
    return f"{name} AS (SELECT {key} AS key, ring, k, {x} + ax * {scale} AS ax, {y} + ay * {scale} AS ay, {x} + cx * {scale} AS cx, {y} + cy * {scale} AS cy FROM {source} CROSS JOIN (VALUES {values}) t(ring, k, ax, ay, cx, cy) WHERE ring = 0 OR {holed})"


#: Even-odd rule and distance over a group of sides s and a place q (x, y).
_INSIDE = "count(*) FILTER (WHERE (s.ay > q.y) <> (s.cy > q.y) AND ((q.x - s.ax) * (s.cy - s.ay) < (s.cx - s.ax) * (q.y - s.ay)) = (s.cy > s.ay) AND (q.x - s.ax) * (s.cy - s.ay) <> (s.cx - s.ax) * (q.y - s.ay)) % 2 = 1"
_EAST = f"(({p.KM_LON} + {p.KM_LON_SLOPE} * (q.y / 100000.0::DOUBLE - {p.REF_LAT})) / 100000)"
_NORTH = f"({p.KM_LAT} / 100000)"
_DX, _DY, _AX, _AY = f"((s.cx - s.ax) * {_EAST})", f"((s.cy - s.ay) * {_NORTH})", f"((s.ax - q.x) * {_EAST})", f"((s.ay - q.y) * {_NORTH})"
_T = f"greatest(0, least(1, coalesce(-({_AX} * {_DX} + {_AY} * {_DY}) / nullif({_DX} * {_DX} + {_DY} * {_DY}, 0), 0)))"
_METRES = f"CAST(floor(min(sqrt(pow({_AX} + {_T} * {_DX}, 2) + pow({_AY} + {_T} * {_DY}, 2))) * 1000 + 0.5) AS BIGINT)"


def _near(places: str, key: str, reach_e5: int, metres: int) -> str:
    """SQL: place key, polygon key, inside, metres of what is inside or within reach, by sides and boxes."""
    return f"""b AS (SELECT key, min(ax) AS w, max(ax) AS e, min(ay) AS s, max(ay) AS n FROM sides GROUP BY key),
near0 AS (SELECT q.{key}, s.key, {_INSIDE} AS inside, {_METRES} AS far FROM {places} q JOIN b ON q.x BETWEEN b.w - {reach_e5} AND b.e + {reach_e5} AND q.y BETWEEN b.s - {reach_e5} AND b.n + {reach_e5} JOIN sides s ON s.key = b.key GROUP BY q.{key}, s.key),
near AS (SELECT {key}, key, inside, CASE WHEN inside THEN 0 ELSE far END AS metres FROM near0 WHERE inside OR far <= {metres})"""


def perimeters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, rings, start_s, end_s."""
    z = frame(spark, sf_dir, "zones")
    shaped = _shaped(z, F.col("lon_e5"), F.col("lat_e5"), F.col("radius_m") / 1000 * UNIT, F.col("zone_id") % 4 == 0)
    return shaped.select(F.col("zone_id").alias("key"), "rings", F.col("created_s").alias("start_s"), (F.col("created_s") + 5 * DAY).alias("end_s"))


_PERIMETERS = _sides("sides", "zones", "zone_id", "lon_e5", "lat_e5", f"(radius_m // 1000 * {UNIT})", "zone_id % 4 = 0")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "detections").select(F.col("event_id").alias("place"), F.col("lon_e5").alias("x"), F.col("lat_e5").alias("y"), F.col("acq_s").alias("at_s"))


_PLACES = "places AS (SELECT event_id AS place, lon_e5 AS x, lat_e5 AS y, acq_s AS at_s FROM detections)"


@query("jn_04_labelled_detections", f"""
WITH places AS (SELECT event_id AS place, lon_e5 AS x, lat_e5 AS y, acq_s AS at_s, greatest(1000, CAST(floor(1000 * CASE source WHEN 'modis' THEN greatest(3.0, 1.5 * sqrt(scan_km * track_km)) WHEN 'geo_msg' THEN 5.5 ELSE 1.25 END + 0.5) AS BIGINT)) AS reach_m FROM detections),
{_PERIMETERS}, b AS (SELECT key, min(ax) AS w, max(ax) AS e, min(ay) AS s, max(ay) AS n FROM sides GROUP BY key),
near0 AS (SELECT q.place, s.key, any_value(q.reach_m) AS reach_m, {_INSIDE} AS inside, {_METRES} AS far FROM zones z JOIN b ON b.key = z.zone_id JOIN places q ON q.at_s BETWEEN z.created_s - {DAY} AND z.created_s + {8 * DAY} AND q.x BETWEEN b.w - 9000 AND b.e + 9000 AND q.y BETWEEN b.s - 9000 AND b.n + 9000 JOIN sides s ON s.key = b.key GROUP BY q.place, s.key),
l AS (SELECT place, key FROM near0 WHERE inside OR far <= reach_m)
SELECT q.place, CASE count(l.key) WHEN 0 THEN 'unlabeled' WHEN 1 THEN 'labeled' ELSE 'ambiguous' END AS verdict, coalesce(list(l.key ORDER BY l.key) FILTER (WHERE l.key IS NOT NULL), []) AS labels FROM places q LEFT JOIN l ON l.place = q.place GROUP BY q.place""")
def labelled_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detection reaches as far as it would link, a kilometre at least; perimeters hold from a day before to three days after."""
    d = frame(spark, sf_dir, "detections")
    at = d.select(F.col("event_id").alias("place"), F.col("lon_e5").alias("x"), F.col("lat_e5").alias("y"), F.col("acq_s").alias("at_s"), F.floor(1000 * ingest.link_distance_km() + 0.5).cast("long").alias("reach_m"))
    return polygons.labelled(at, perimeters(spark, sf_dir).withColumnRenamed("key", "label"), 1000, DAY, 3 * DAY)


@query("jn_05_within_perimeters", f"WITH {_PLACES}, {_PERIMETERS}, {_near('places', 'place', 1600, 1000)} SELECT place, key, inside, metres FROM near")
def within_perimeters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons.shared_pairs(places(spark, sf_dir).drop("at_s"), perimeters(spark, sf_dir).select("key", "rings"), 1000).drop("x", "y")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region, rings: side by side with gaps, each with a hole."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    x, y = 2310000 + F.col("n_nationkey") % 5 * 120000, 4130000 + F.floor(F.col("n_nationkey") / 5) * 60000
    return _shaped(n, x, y, F.lit(320), F.lit(True)).select(F.col("n_nationkey").cast("long").alias("region"), "rings")


_REGIONS = _sides("sides", "{nation}", "n_nationkey", "(2310000 + n_nationkey % 5 * 120000)", "(4130000 + n_nationkey // 5 * 60000)", "320", "TRUE")


@query("jn_35_regions", f"WITH {_PLACES}, {_REGIONS}, {_near('places', 'place', 3000, 2000)}, f AS (SELECT place, key, row_number() OVER (PARTITION BY place ORDER BY metres, key) AS r FROM near) SELECT q.place, f.key::BIGINT AS region FROM places q LEFT JOIN f ON f.place = q.place AND f.r = 1")
def place_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons.region_of(places(spark, sf_dir).drop("at_s"), regions(spark, sf_dir), 2000)


@query("flt_17_events_of_region", f"WITH places AS (SELECT fire_id AS place, lon_e5 AS x, lat_e5 AS y FROM fires), {_REGIONS}, {_near('places', 'place', 3000, 2000)}, f AS (SELECT place, key, row_number() OVER (PARTITION BY place ORDER BY metres, key) AS r FROM near) SELECT place AS fire_id FROM f WHERE r = 1 AND key IN (2, 7, 11)")
def events_of_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, sf_dir, "fires").select(F.col("fire_id").alias("place"), F.col("lon_e5").alias("x"), F.col("lat_e5").alias("y"))
    return polygons.region_of(f, regions(spark, sf_dir), 2000).filter(F.col("region").isin(2, 7, 11)).select(F.col("place").alias("fire_id"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    x, y = 2250000 + F.col("s_suppkey") * 104729 % 600 * 1000, 4100000 + F.col("s_suppkey") * 7919 % 300 * 1000
    return _shaped(s, x, y, (3 + F.col("s_suppkey") % 12) * UNIT, F.lit(False)).select(F.col("s_suppkey").alias("site"), "rings")


_SITES = _sides("sides", "{supplier}", "s_suppkey", "(2250000 + s_suppkey * 104729 % 600 * 1000)", "(4100000 + s_suppkey * 7919 % 300 * 1000)", f"((3 + s_suppkey % 12) * {UNIT})", "FALSE")


@query("jn_34_protected_sites", f"""
WITH m AS (SELECT event_id AS place, fire_id, lon_e5 AS x, lat_e5 AS y FROM members), {_SITES}, {_near("m", "place", 7000, 5000)},
g AS (SELECT m.fire_id, n.key, count(*) FILTER (WHERE inside) AS positions, min(metres) AS metres FROM near n JOIN m ON m.place = n.place GROUP BY m.fire_id, n.key), f AS (SELECT *, row_number() OVER (PARTITION BY fire_id ORDER BY positions DESC, metres, key) AS r FROM g)
SELECT fire_id AS key, key AS site, CASE WHEN positions > 0 THEN 'inside' ELSE 'near' END AS relation, positions, metres FROM f WHERE r = 1""")
def protected_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = frame(spark, sf_dir, "members").select(F.col("fire_id").alias("key"), F.col("lon_e5").alias("x"), F.col("lat_e5").alias("y"))
    return polygons.site_relation(m, sites(spark, sf_dir), 5000)


def static_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, rings, kind: every third is an outline, the others are points."""
    t = spark.read.parquet(f"{sf_dir}/part.parquet")
    x, y = 2250000 + F.col("p_partkey") * 15485863 % 600000, 4100000 + F.col("p_partkey") * 32452843 % 300000
    outline, point = _ring(x, y, F.lit(8), OUTER), F.array(F.struct(x.alias("x"), y.alias("y")))
    kind = F.element_at(F.array(*map(F.lit, ("solar", "industrial", "flare"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    return t.select(F.col("p_partkey").alias("source"), F.array(F.when(F.col("p_partkey") % 3 == 0, outline).otherwise(point)).alias("rings"), kind.alias("kind"))


_SOURCES = "x0 AS (SELECT p_partkey, 2250000 + p_partkey * 15485863 % 600000 AS x, 4100000 + p_partkey * 32452843 % 300000 AS y FROM {part}), " + _sides("outlines", "x0", "p_partkey", "x", "y", "8", "FALSE") + ", sides AS (SELECT * FROM outlines WHERE key % 3 = 0 UNION ALL SELECT p_partkey, 0, 0, x, y, x, y FROM x0 WHERE p_partkey % 3 <> 0)"


@query("jn_33_static_sources", f"WITH places AS (SELECT fire_id AS place, lon_e5 AS x, lat_e5 AS y FROM fires), {_SOURCES}, {_near('places', 'place', 2500, 1500)} SELECT place, array_to_string(list(metres || ':' || key ORDER BY metres, key), ',') AS sources FROM near GROUP BY place")
def near_static_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, sf_dir, "fires").select(F.col("fire_id").alias("place"), F.col("lon_e5").alias("x"), F.col("lat_e5").alias("y"))
    found = polygons.sources_within(f, static_sources(spark, sf_dir).select("source", "rings"), 1500)
    return found.select("place", F.array_join(F.transform("sources", lambda s: F.concat_ws(":", s["metres"], s["source"])), ",").alias("sources"))


@query("src_46_mask_cells", f"WITH {_SOURCES} SELECT key AS source, unnest(range(r0, r1 + 1)) AS r, c FROM (SELECT key, CAST(floor(min(ay) / 2000.0) AS BIGINT) AS r0, CAST(floor(max(ay) / 2000.0) AS BIGINT) AS r1, unnest(range(CAST(floor(min(ax) / 2000.0) AS BIGINT), CAST(floor(max(ax) / 2000.0) AS BIGINT) + 1)) AS c FROM sides GROUP BY key) t")
def mask_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask's grid index: sources by the cells of a fiftieth of a degree that their boxes touch."""
    at = static_sources(spark, sf_dir).select("source", r.box(F.col("rings")).alias("b"))
    side = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / 2000), F.floor(F.col(high) / 2000)))
    return at.withColumn("r", side("b.south", "b.north")).withColumn("c", side("b.west", "b.east")).select("source", "r", "c")


_FAR_KM = f"sqrt(pow((v.y - w.y) / 100000.0::DOUBLE * {p.KM_LAT}, 2) + pow((v.x - w.x) / 100000.0::DOUBLE * ({p.KM_LON} + {p.KM_LON_SLOPE} * ((v.y + w.y) / 200000.0::DOUBLE - {p.REF_LAT})), 2))"


@query("jn_41_perimeter_pairs", f"""
WITH {_PERIMETERS}, v AS (SELECT key, ax AS x, ay AS y FROM sides), g AS (SELECT a.zone_id AS a, b.zone_id AS b FROM zones a JOIN zones b ON a.zone_id < b.zone_id AND abs(a.created_s - b.created_s) <= {5 * DAY} AND abs(a.lat_e5 - b.lat_e5) <= (a.radius_m + b.radius_m) + 3000 AND abs(a.lon_e5 - b.lon_e5) <= (a.radius_m + b.radius_m) + 3000)
SELECT g.a, g.b, CAST(floor(min({_FAR_KM}) * 1000 + 0.5) AS BIGINT) AS gap_m FROM g JOIN v ON v.key = g.a JOIN v w ON w.key = g.b GROUP BY g.a, g.b HAVING CAST(floor(min({_FAR_KM}) * 1000 + 0.5) AS BIGINT) < 2000""")
def perimeter_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons.polygon_pairs(perimeters(spark, sf_dir), 2000)


@query("jn_42_vertex_gaps", f"WITH {_PERIMETERS}, v AS (SELECT key, ax AS x, ay AS y FROM sides WHERE ring = 0) SELECT v.key AS zone_id, CAST(floor(min({_FAR_KM}) * 1000 + 0.5) AS BIGINT) AS gap_m FROM v JOIN v w ON w.key = v.key + 1 GROUP BY v.key")
def vertex_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = perimeters(spark, sf_dir).select(F.col("key").alias("zone_id"), F.col("rings")[0].alias("a"))
    other = own.select((F.col("zone_id") - 1).alias("zone_id"), F.col("a").alias("b"))
    return own.join(other, "zone_id").select("zone_id", r.vertex_gap_m(F.col("a"), F.col("b")).alias("gap_m"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, class of the pixels that detections stand in, off their corners."""
    d = frame(spark, sf_dir, "detections")
    at = lambda c, k: (F.col(c) - F.col(c) % 250 + (F.col("event_id") * k) % 250).alias
    return d.select(at("lon_e5", 37)("x"), at("lat_e5", 53)("y"), ((F.col("event_id") * 7 + F.col("user_id") * 13) % 5).alias("class"))


_PIXELS = "px AS (SELECT event_id AS pixel, lon_e5 - lon_e5 % 250 + event_id * 37 % 250 AS x, lat_e5 - lat_e5 % 250 + event_id * 53 % 250 AS y, (event_id * 7 + user_id * 13) % 5 AS class FROM detections)"


@query("agg_49_zonal_counts", f"WITH {_PIXELS}, {_PERIMETERS}, {_near('px', 'pixel', 0, -1)} SELECT n.key, px.class, count(*) AS pixels FROM near n JOIN px ON px.pixel = n.pixel WHERE n.inside GROUP BY n.key, px.class")
def zonal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons.class_counts(pixels(spark, sf_dir), perimeters(spark, sf_dir).select("key", "rings"))


@query("agg_47_class_histogram", f"WITH {_PIXELS} SELECT y // 20000 AS cell_r, x // 20000 AS cell_c, " + ", ".join(f"count(*) FILTER (WHERE class = {k}) AS c{k}" for k in range(5)) + " FROM px GROUP BY 1, 2")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons.class_histogram(pixels(spark, sf_dir), list(range(5)), 20000)


_CROSS = "(s.ax - o.x) * (s.cy - o.y) - (s.cx - o.x) * (s.ay - o.y)"


@query("agg_51_centroids", f"""
WITH {_PERIMETERS}, o AS (SELECT key, ax AS x, ay AS y FROM sides WHERE ring = 0 AND k = 0)
SELECT s.key AS zone_id, CAST(floor((any_value(o.x) + sum((s.ax + s.cx - 2 * o.x) * ({_CROSS}))::BIGINT / (3 * sum({_CROSS})::BIGINT)::DOUBLE) * 10 + 0.5) AS BIGINT) AS x_e6, CAST(floor((any_value(o.y) + sum((s.ay + s.cy - 2 * o.y) * ({_CROSS}))::BIGINT / (3 * sum({_CROSS})::BIGINT)::DOUBLE) * 10 + 0.5) AS BIGINT) AS y_e6
FROM sides s JOIN o ON o.key = s.key GROUP BY s.key""")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = perimeters(spark, sf_dir).select(F.col("key").alias("zone_id"), r.centroid(F.col("rings"), F.col("rings")[0][0]).alias("c"))
    return at.select("zone_id", F.floor(F.col("c.x") * 10 + 0.5).cast("long").alias("x_e6"), F.floor(F.col("c.y") * 10 + 0.5).cast("long").alias("y_e6"))


@query("geo_10_spherical_areas", f"WITH {_PERIMETERS} SELECT key AS zone_id, CAST(floor(abs(sum(radians((cx - ax) / 100000.0::DOUBLE) * (2 + sin(radians(ay / 100000.0::DOUBLE)) + sin(radians(cy / 100000.0::DOUBLE))))) * {p.EARTH_KM * 1000} * {p.EARTH_KM * 1000} / 2 / 1000 + 0.5) AS BIGINT) AS area_m2_e3 FROM sides WHERE ring = 0 GROUP BY key")
def spherical_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perimeters(spark, sf_dir).select(F.col("key").alias("zone_id"), F.floor(r.spherical_m2(F.col("rings")[0]) / 1000 + 0.5).cast("long").alias("area_m2_e3"))


@query("udf_05_delta_coded_rings", f"""
WITH {_PERIMETERS}, v AS (SELECT key, k, CAST(floor(ax / 1000.0 + 0.5) AS BIGINT) AS x, CAST(floor(ay / 1000.0 + 0.5) AS BIGINT) AS y FROM sides WHERE ring = 0), w AS (SELECT *, lag(x) OVER g AS px, lag(y) OVER g AS py FROM v WINDOW g AS (PARTITION BY key ORDER BY k))
SELECT key AS zone_id, array_to_string(list((x - coalesce(px, 0)) || ',' || (y - coalesce(py, 0)) ORDER BY k), ',') AS code FROM w WHERE px IS NULL OR x <> px OR y <> py GROUP BY key""")
def delta_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perimeters(spark, sf_dir).select(F.col("key").alias("zone_id"), F.array_join(r.delta_coded(F.col("rings")[0], 1000).cast("array<string>"), ",").alias("code"))


def _cut_sql(step: int, axis: str, bound: str, op: str) -> str:
    """SQL: list l of step - 1 cut at a line, as l of this step."""
    o = "y" if axis == "x" else "x"
    now, was = "l[i]", "l[CASE WHEN i = 1 THEN len(l) ELSE i - 1 END]"
    at = f"CAST(floor({was}.{o} + ({now}.{o} - {was}.{o}) * ({bound} - {was}.{axis}) / ({now}.{axis} - {was}.{axis})::DOUBLE + 0.5) AS BIGINT)"
    crossing = f"{{'x': {bound if axis == 'x' else at}, 'y': {bound if axis == 'y' else at}}}"
    return f"c{step} AS (SELECT key, w, s, e, n, flatten(list_transform(range(1, len(l) + 1), lambda i: list_concat(CASE WHEN ({now}.{axis} {op} {bound}) <> ({was}.{axis} {op} {bound}) THEN [{crossing}] ELSE [] END, CASE WHEN {now}.{axis} {op} {bound} THEN [{now}] ELSE [] END))) AS l FROM c{step - 1})"


@query("udf_06_clipped_rings", f"""
WITH {_PERIMETERS}, c0 AS (SELECT s.key, any_value(z.lon_e5 - z.radius_m * 2 // 5) AS w, any_value(z.lat_e5 - z.radius_m // 2) AS s, any_value(z.lon_e5 + z.radius_m // 2) AS e, any_value(z.lat_e5 + z.radius_m * 3 // 5) AS n, list({{'x': ax, 'y': ay}} ORDER BY k) AS l FROM sides s JOIN zones z ON z.zone_id = s.key WHERE ring = 0 GROUP BY s.key),
{_cut_sql(1, 'x', 'w', '>=')}, {_cut_sql(2, 'x', 'e', '<=')}, {_cut_sql(3, 'y', 's', '>=')}, {_cut_sql(4, 'y', 'n', '<=')}
SELECT key AS zone_id, array_to_string(list_transform(l, lambda v: v.x || ' ' || v.y), ',') AS ring FROM c4""")
def clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = frame(spark, sf_dir, "zones")
    part = lambda num, den: F.floor(F.col("radius_m") * num / den).cast("long")
    box = F.struct((F.col("lon_e5") - part(2, 5)).alias("west"), (F.col("lat_e5") - part(1, 2)).alias("south"), (F.col("lon_e5") + part(1, 2)).alias("east"), (F.col("lat_e5") + part(3, 5)).alias("north"))
    rows = perimeters(spark, sf_dir).select(F.col("key").alias("zone_id"), F.col("rings")[0].alias("ring")).join(z.select("zone_id", box.alias("b")), "zone_id")
    out = rows.select("zone_id", r.clipped(F.col("ring"), F.col("b")).alias("l"))
    return out.select("zone_id", F.array_join(F.transform("l", lambda v: F.concat_ws(" ", v["x"], v["y"])), ",").alias("ring"))
