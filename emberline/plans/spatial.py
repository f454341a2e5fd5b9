"""Queries of the spatial, temporal and set joins and of event scores, with the same results in SQL by plainer means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline import params as p
from emberline.functions import geo
from emberline.operators import joins, scoring
from emberline.operators.graph import written
from emberline.plans.catalog import both, frame, query
from emberline.plans.relational import DAY, NOW


def km(a: str, b: str) -> str:
    """SQL: planar kilometres between two aliases with lat and lon."""
    dlon = f"(({b}.lon - {a}.lon) * (CAST({p.KM_LON} AS DOUBLE) + CAST({p.KM_LON_SLOPE} AS DOUBLE) * (({a}.lat + {b}.lat) / 2 - CAST({p.REF_LAT} AS DOUBLE))))"
    dlat = f"(({b}.lat - {a}.lat) * CAST({p.KM_LAT} AS DOUBLE))"
    return f"sqrt({dlon} * {dlon} + {dlat} * {dlat})"


def quanta(x: str) -> str:
    return f"CAST(floor(({x}) / 0.000001 + 0.5) AS BIGINT)"


def haversine(a: str, b: str) -> str:
    h = f"pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)"
    return f"(2 * CAST({p.EARTH_KM} AS DOUBLE) * asin(sqrt(least(1.0, {h}))))"


_PRIOR = " ".join(f"WHEN fam = '{f}'{'' if c == 'any' else f' AND confidence = {chr(39)}{c}{chr(39)}'} THEN CASE WHEN day_night = 'N' THEN {dark} ELSE {day} END" for (f, c), (day, dark) in p.PRIORS.items())
SCORE_SQL = f"""
WITH g AS (SELECT *, CASE WHEN source LIKE 'viirs%' THEN 'viirs' WHEN source LIKE 'geo%' THEN 'geo' ELSE source END AS fam, CASE WHEN source = 'modis' THEN 'terra_aqua' WHEN source LIKE 'viirs%' THEN substring(source, 7) WHEN source LIKE 'geo%' THEN substring(source, 5) ELSE 'sentinel3' END AS platform,
    CASE WHEN source LIKE 'geo%' THEN 'geo|' || CAST(acq_s // 10800 AS VARCHAR) ELSE CASE WHEN source = 'modis' THEN 'terra_aqua' ELSE substring(source, 7) END || '|' || CAST(acq_s // 86400 AS VARCHAR) || '|' || day_night END AS overpass
  FROM members WHERE NOT (over_water AND day_night = 'D' AND confidence = 'low')),
x AS (SELECT *, CAST(CASE {_PRIOR} END AS DOUBLE) AS prior, fam <> 'geo' AS scanning, fam <> 'geo' AND scan_km * track_km > 2 * CASE WHEN fam = 'viirs' THEN 0.140625 ELSE 1.0 END AS edge FROM g),
pts AS (SELECT DISTINCT fire_id, overpass, lat_e5, lon_e5, lat, lon FROM x),
ab AS (SELECT a.fire_id, a.overpass, a.lat_e5 AS a1, a.lon_e5 AS a2, b.lat_e5 AS b1, b.lon_e5 AS b2 FROM pts a JOIN pts b ON a.fire_id = b.fire_id AND a.overpass = b.overpass AND (b.lat_e5, b.lon_e5) > (a.lat_e5, a.lon_e5) WHERE {quanta(km('a', 'b'))} <= {quanta(str(p.COHERENT_KM))}),
co AS (SELECT DISTINCT p.fire_id FROM ab p JOIN ab q ON q.fire_id = p.fire_id AND q.overpass = p.overpass AND q.a1 = p.b1 AND q.a2 = p.b2 JOIN ab r ON r.fire_id = p.fire_id AND r.overpass = p.overpass AND r.a1 = p.a1 AND r.a2 = p.a2 AND r.b1 = q.b1 AND r.b2 = q.b2),
f AS (SELECT x.fire_id, count(*) AS rows, max(prior) AS best, least(count(DISTINCT overpass) - 1, 3) / 3 AS persist, CASE WHEN count(DISTINCT platform) >= 2 THEN 1.0 ELSE 0.0 END AS multisource, CASE WHEN bool_or(day_night = 'N') THEN 1.0 ELSE 0.0 END AS night,
    CASE WHEN x.fire_id IN (SELECT fire_id FROM co) THEN 1.0 ELSE 0.0 END AS coherence, coalesce(least(ln(1 + max(frp)) / ln(101.0), 1.0), 0.0) AS frp,
    CASE WHEN bool_or(scanning) AND count(*) FILTER (WHERE scanning AND NOT edge) = 0 THEN 1.0 ELSE 0.0 END AS edge, CASE WHEN bool_and(day_night = 'D' AND confidence = 'low') THEN 1.0 ELSE 0.0 END AS glint FROM x GROUP BY x.fire_id),
s AS (SELECT *, CAST(floor(1e6 / (1 + exp(-({p.WEIGHTS['intercept']} + {' + '.join(f'CAST({k} AS DOUBLE) * {w}' for k, w in p.WEIGHTS.items() if k != 'intercept')}))) + 0.5) AS BIGINT) AS score_e6 FROM f)
SELECT fire_id, rows, score_e6, CASE WHEN score_e6 >= 750000 THEN 'confirmed' WHEN score_e6 >= 450000 THEN 'likely' ELSE 'unverified' END AS bucket, CAST(coherence AS INT) AS coherence, CAST(edge AS INT) AS edge FROM s"""


@query("agg_01_event_scores", SCORE_SQL)
def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = scoring.score(scoring.features(frame(spark, sf_dir, "members"), "fire_id"))
    return scored.select("fire_id", "rows", "score_e6", "bucket", F.col("coherence").cast("int").alias("coherence"), F.col("edge").cast("int").alias("edge"))


@query("jn_07_zone_matches", f"SELECT z.zone_id, f.fire_id, {quanta(km('z', 'f'))} AS km_q FROM zones z JOIN fires f ON {quanta(km('z', 'f'))} <= {quanta('CAST(z.radius_m AS DOUBLE) / 1000')}")
def zone_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = frame(spark, sf_dir, "zones").select("zone_id", "lat", "lon", "radius_m")
    pairs = joins.radius_join(zones, frame(spark, sf_dir, "fires").select("fire_id", "lat", "lon"), F.col("radius_m").cast("double") / 1000)
    return pairs.select("zone_id", F.col("r_fire_id").alias("fire_id"), "km_q")


_GAP = "c.started_s - q.last_s"


def _places_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fires' places and times, kept as a table: they are read for both sides of a pair and for the result."""
    return written(frame(spark, sf_dir, "fires").select("fire_id", "lat", "lon", "started_s", "last_s"), "fires")


@query("jn_02_reignitions", f"""
SELECT child, parent, gap_s, km_q FROM (SELECT c.fire_id AS child, q.fire_id AS parent, {_GAP} AS gap_s, {quanta(km('c', 'q'))} AS km_q, row_number() OVER (PARTITION BY c.fire_id ORDER BY {quanta(km('c', 'q'))}, q.started_s, q.fire_id) AS r
FROM fires c JOIN fires q ON c.fire_id <> q.fire_id AND {_GAP} > 172800 AND {_GAP} <= {14 * DAY} AND {quanta(km('c', 'q'))} <= {quanta('11.0')}) x WHERE r = 1""")
def reignitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    fires = _places_in_time(spark, sf_dir)
    return joins.reignitions(fires, fires, F.lit(14 * DAY), 11.0)


@query("jn_01_reignition_candidates", f"SELECT DISTINCT q.fire_id FROM fires c JOIN fires q ON q.last_s BETWEEN c.started_s - {21 * DAY} AND c.started_s - 172800 AND {quanta(km('c', 'q'))} <= {quanta('11.0')}")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    fires = _places_in_time(spark, sf_dir)
    return joins.followed(fires, 11.0, 172800, 21 * DAY).select("fire_id")


@query("jn_06_hard_negatives", f"SELECT a.event_id AS a, b.event_id AS b FROM members a JOIN members b ON a.event_id < b.event_id AND a.fire_id <> b.fire_id AND abs(a.acq_s - b.acq_s) <= 7200 AND {quanta(km('a', 'b'))} <= {quanta('2.0')}")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.near_pairs(frame(spark, sf_dir, "members"), "event_id", "fire_id", 2.0, 7200)


@query("jn_37_flash_context", f"""
WITH l AS (SELECT acq_s AS t_s, lat + 0.01 AS lat, lon + 0.01 AS lon FROM detections WHERE event_id % 2 = 0)
SELECT f.fire_id, count(l.t_s) AS flashes, CAST(floor(min(CASE WHEN l.t_s IS NOT NULL THEN {haversine('f', 'l')} END) * 1000 + 0.5) AS BIGINT) AS nearest_m FROM fires f LEFT JOIN l ON l.t_s BETWEEN f.started_s - 10800 AND f.started_s AND {haversine('f', 'l')} <= 10 GROUP BY f.fire_id""")
def flash_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    flashes = frame(spark, sf_dir, "detections").filter("event_id % 2 = 0").select(F.col("acq_s").alias("t_s"), (F.col("lat") + 0.01).alias("lat"), (F.col("lon") + 0.01).alias("lon"))
    return joins.flash_context(frame(spark, sf_dir, "fires"), flashes)


@query("jn_38_bracket_join", """
WITH s AS (SELECT user_id, acq_s - acq_s % 21600 AS step_s, max(CAST(floor(frp) AS BIGINT)) AS v FROM detections GROUP BY 1, 2), r AS (SELECT event_id, user_id, acq_s FROM detections),
a AS (SELECT r.event_id, s.step_s, s.v, row_number() OVER (PARTITION BY r.event_id ORDER BY s.step_s DESC) AS n FROM r JOIN s ON s.user_id = r.user_id AND s.step_s <= r.acq_s),
b AS (SELECT r.event_id, s.step_s, s.v, row_number() OVER (PARTITION BY r.event_id ORDER BY s.step_s) AS n FROM r JOIN s ON s.user_id = r.user_id AND s.step_s >= r.acq_s)
SELECT r.event_id, CASE WHEN b.step_s - a.step_s <= 43200 THEN CAST(floor(CASE WHEN b.step_s = a.step_s THEN CAST(a.v AS DOUBLE) ELSE CAST(a.v AS DOUBLE) + CAST(b.v - a.v AS DOUBLE) * (r.acq_s - a.step_s) / (b.step_s - a.step_s) END + 0.5) AS BIGINT) END AS value_q
FROM r LEFT JOIN a ON a.event_id = r.event_id AND a.n = 1 LEFT JOIN b ON b.event_id = r.event_id AND b.n = 1""")
def bracket_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frame(spark, sf_dir, "detections")
    series = d.groupBy("user_id", (F.col("acq_s") - F.col("acq_s") % 21600).alias("step_s")).agg(F.max(F.floor("frp")).alias("v"))
    rows = d.select("event_id", "user_id", "acq_s")
    return joins.bracket(rows, series, "user_id", "acq_s", "step_s", "v", 43200).select("event_id", "value_q")


@query("jn_39_nearest_step", f"WITH s AS (SELECT DISTINCT source, acq_s - acq_s % 10800 AS step_s FROM detections) SELECT source, step_s FROM (SELECT source, step_s, row_number() OVER (PARTITION BY source ORDER BY abs(step_s - {NOW - 9 * DAY - 700}), step_s) AS r FROM s WHERE abs(step_s - {NOW - 9 * DAY - 700}) <= 5400) x WHERE r = 1")
def nearest_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = NOW - 9 * DAY - 700
    steps = frame(spark, sf_dir, "detections").select("source", (F.col("acq_s") - F.col("acq_s") % 10800).alias("step_s")).filter(F.abs(F.col("step_s") - at) <= 5400)
    return steps.groupBy("source").agg(F.min_by("step_s", F.struct(F.abs(F.col("step_s") - at), F.col("step_s"))).alias("step_s"))


_SETS = "a AS (SELECT fire_id AS k, uid AS e FROM members WHERE event_id % 7 <> 0), b AS (SELECT fire_id - fire_id % 2 AS k, uid AS e FROM members WHERE event_id % 5 <> 0)"
_JACCARD = f"WITH {_SETS}, na AS (SELECT k, count(DISTINCT e) AS n FROM a GROUP BY k), nb AS (SELECT k, count(DISTINCT e) AS n FROM b GROUP BY k), c AS (SELECT a.k AS l_key, b.k AS r_key, count(DISTINCT a.e) AS common FROM a JOIN b ON a.e = b.e GROUP BY a.k, b.k), j AS (SELECT l_key, r_key, common, na.n + nb.n - common AS united FROM c JOIN na ON na.k = l_key JOIN nb ON nb.k = r_key) SELECT l_key, r_key, common, united FROM j WHERE common >= 0.3 * united"


def _jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = frame(spark, sf_dir, "members")  # a uid stands for one event_id, which is an eighth as long
    left = m.filter("event_id % 7 <> 0").select(F.col("fire_id").alias("key"), F.col("event_id").alias("element"))
    right = m.filter("event_id % 5 <> 0").select((F.col("fire_id") - F.col("fire_id") % 2).alias("key"), F.col("event_id").alias("element"))
    return joins.jaccard_pairs(left, right, 0.3)


@query("jn_28_jaccard_pairs", _JACCARD)
def jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _jaccard(spark, sf_dir)


@query("jn_28_greedy_matching")
def matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.mutual_matches(_jaccard(spark, sf_dir), [F.desc(F.col("common") / F.col("united")), F.col("l_key"), F.col("r_key")])


@query("jn_29_parity", "WITH t AS (SELECT source, uid FROM detections WHERE event_id % 10 <> 1), o AS (SELECT source, uid FROM detections WHERE event_id % 13 <> 2 OR source = 'modis') SELECT coalesce(t.source, o.source) AS source, count(*) FILTER (WHERE t.uid IS NOT NULL AND o.uid IS NOT NULL) AS matched, count(*) FILTER (WHERE o.uid IS NULL) AS missing, count(*) FILTER (WHERE t.uid IS NULL) AS extra, CASE WHEN count(*) FILTER (WHERE o.uid IS NULL) > 0 THEN 'deficit' ELSE 'parity' END AS verdict FROM t FULL OUTER JOIN o ON o.source = t.source AND o.uid = t.uid GROUP BY 1")
def parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = frame(spark, sf_dir, "detections")
    return joins.parity(d.filter("event_id % 10 <> 1"), d.filter("event_id % 13 <> 2 OR source = 'modis'"), "uid", "source")


@query("jn_27_path_compression", "WITH RECURSIVE c(alias, canonical, depth) AS (SELECT alias, merged_into, 1 FROM aliases WHERE merged_into IS NOT NULL UNION ALL SELECT c.alias, a.merged_into, c.depth + 1 FROM c JOIN aliases a ON a.alias = c.canonical WHERE a.merged_into IS NOT NULL) SELECT alias, arg_max(canonical, depth) AS canonical FROM c GROUP BY alias")
def path_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.closure(frame(spark, sf_dir, "aliases"), "alias", "merged_into")


@query("jn_26_resolve_alias", "WITH RECURSIVE c(alias, canonical, depth) AS (SELECT alias, alias, 0 FROM aliases UNION ALL SELECT c.alias, a.merged_into, c.depth + 1 FROM c JOIN aliases a ON a.alias = c.canonical WHERE a.merged_into IS NOT NULL) SELECT alias, arg_max(canonical, depth) AS canonical FROM c GROUP BY alias")
def resolve_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = frame(spark, sf_dir, "aliases")
    ends = joins.closure(a, "alias", "merged_into")
    return a.select("alias").join(ends, "alias", "left").select("alias", F.coalesce("canonical", "alias").alias("canonical"))


@query("jn_32_static_sources", f"""
WITH mask AS (SELECT s_suppkey AS site, 41 + (s_suppkey * 7919 % 300) / 100.0 AS lat0, 22.5 + (s_suppkey * 104729 % 600) / 100.0 AS lon0, CASE s_suppkey % 3 WHEN 0 THEN 1 ELSE 0 END AS override FROM {{supplier}}), k AS (SELECT site, override, CAST(lat0 AS DOUBLE) AS lat, CAST(lon0 AS DOUBLE) AS lon FROM mask)
SELECT event_id, site, override FROM (SELECT d.event_id, k.site, k.override, row_number() OVER (PARTITION BY d.event_id ORDER BY k.override DESC, {quanta(km('d', 'k'))}, k.site) AS r FROM detections d JOIN k ON {quanta(km('d', 'k'))} <= {quanta('5.0')}) x WHERE r = 1""")
def static_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    mask = s.select(F.col("s_suppkey").alias("site"), (41 + (F.col("s_suppkey") * 7919 % 300) / 100).alias("lat"), (22.5 + (F.col("s_suppkey") * 104729 % 600) / 100).alias("lon"), F.when(F.col("s_suppkey") % 3 == 0, 1).otherwise(0).alias("override"))
    found = joins.nearest(frame(spark, sf_dir, "detections").select("event_id", "lat", "lon"), mask, "site", 5.0, rank=-F.col("override"))
    return found.select("event_id", F.col("r_key").alias("site"), (-F.col("r_rank")).alias("override"))


# --- scalar functions of place
_AT = "SELECT event_id, lat, lon FROM detections"


@query("geo_01_planar_distance", f"WITH h AS (SELECT CAST(42.7 AS DOUBLE) AS lat, CAST(25.5 AS DOUBLE) AS lon) SELECT d.event_id, {quanta(km('d', 'h'))} AS km_q FROM detections d CROSS JOIN h")
def planar_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "detections").select("event_id", geo.quantize(geo.planar_km(F.col("lat"), F.col("lon"), F.lit(42.7), F.lit(25.5))).alias("km_q"))


@query("geo_07_great_circle", f"WITH h AS (SELECT CAST(42.7 AS DOUBLE) AS lat, CAST(25.5 AS DOUBLE) AS lon) SELECT d.event_id, CAST(floor({haversine('d', 'h')} * 1000 + 0.5) AS BIGINT) AS metres FROM detections d CROSS JOIN h")
def great_circle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "detections").select("event_id", F.floor(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(42.7), F.lit(25.5)) * 1000 + 0.5).cast("long").alias("metres"))


@query("geo_13_compass", "WITH b AS (SELECT event_id, (degrees(atan2(sin(radians(25.5 - lon)) * cos(radians(42.7)), cos(radians(lat)) * sin(radians(42.7)) - sin(radians(lat)) * cos(radians(42.7)) * cos(radians(25.5 - lon)))) + 360) % 360 AS b FROM detections) SELECT event_id, CAST(floor(b * 1000 + 0.5) AS BIGINT) AS bearing_e3, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][CAST(floor(b / 45 + 0.5) AS BIGINT) % 8 + 1] AS compass FROM b")
def compass(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = geo.bearing_degrees(F.col("lat"), F.col("lon"), F.lit(42.7), F.lit(25.5))
    return frame(spark, sf_dir, "detections").select("event_id", F.floor(b * 1000 + 0.5).cast("long").alias("bearing_e3"), geo.compass(b).alias("compass"))


@query("geo_23_cell_key", "SELECT event_id, CAST(CAST(floor(lat * 20) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(floor(lon * 20) AS BIGINT) AS VARCHAR) AS cell FROM detections")
def cell_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "detections").select("event_id", geo.cell(F.col("lat"), F.col("lon")).alias("cell"))


both("geo_24_coarse_centre", "SELECT zone_id, CAST(floor(lat * 100) AS BIGINT) * 2 + 1 AS lat_200, CAST(floor(lon * 100) AS BIGINT) * 2 + 1 AS lon_200 FROM zones")
both("geo_11_display_length", "SELECT zone_id, CASE WHEN radius_m * 3 < 10000 THEN 'tenth' ELSE 'whole' END AS step, CASE WHEN radius_m * 3 < 10000 THEN CAST(floor(radius_m * 3 / 100.0 + 0.5) AS BIGINT) ELSE CAST(floor(radius_m * 3 / 1000.0 + 0.5) AS BIGINT) * 10 END AS km_tenths FROM zones")
both("geo_16_nearest_in_box", "SELECT event_id, greatest(4150000, least(4350000, lat_e5)) AS lat_e5, greatest(2300000, least(2700000, lon_e5)) AS lon_e5 FROM detections")
both("geo_30_tile", "SELECT event_id, CAST(floor((lon + 180) / 360 * 1024) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 1024) AS BIGINT) AS y FROM detections")
both("geo_35_bucket", "SELECT fire_id, CASE WHEN score >= 0.75 THEN 'confirmed' WHEN score >= 0.45 THEN 'likely' ELSE 'unverified' END AS bucket FROM fires")
_WIND = "SELECT event_id, CAST(floor(degrees(atan2(-(frp - 200), -(lat_e5 % 1000 - 480.5))) + 0.5) AS BIGINT) % 360 AS toward, CAST(floor(sqrt((frp - 200) * (frp - 200) + (lat_e5 % 1000 - 480.5) * (lat_e5 % 1000 - 480.5)) * 10 + 0.5) AS BIGINT) AS speed_tenths FROM detections"
# The angle of -0.0 is -180 in SQL; Spark's atan2 makes it 0.0, whose angle is 180.
both("geo_41_wind", _WIND.replace("CAST(floor(degrees", "CASE WHEN frp = 200 AND lat_e5 % 1000 > 480.5 THEN CAST(-180 AS BIGINT) ELSE CAST(floor(degrees").replace("% 360 AS", "% 360 END AS"), _WIND)
both("geo_43_danger_class", "SELECT event_id, CASE WHEN frp < 5.2 THEN 'very_low' WHEN frp < 11.2 THEN 'low' WHEN frp < 21.3 THEN 'moderate' WHEN frp < 38 THEN 'high' WHEN frp < 50 THEN 'very_high' ELSE 'extreme' END AS danger FROM detections")
both("geo_39_frp_feature", "SELECT event_id, CAST(floor(1e6 * least(ln(1 + frp) / ln(101.0), 1.0) + 0.5) AS BIGINT) AS frp_e6 FROM detections")
