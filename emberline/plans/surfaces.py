"""Queries of what covers ground: swaths of passes over a box, and mixtures of groups in blocks of a raster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline import params as p
from emberline.operators import mixture, swath
from emberline.plans.catalog import query, spark_sql

#: Seconds between samples; the box (west, south, east, north) and the swath's width in kilometres.
STEP, BOX, SWATH_KM = 30, (19.0, 34.0, 29.0, 42.0), 3000.0
_NEAR = ", ".join(f"({d})" for d in range(-10, 11))
#: Where a satellite is in a slot; in some it has no position.
_PLACES = f"""slot * {STEP} AS t_s, CASE WHEN slot % 17 <> 0 THEN CAST(abs((slot * 200300 + satellite * 1700000) % 32000000 - 16000000) - 8000000 AS DOUBLE) / 100000 END AS lat,
       CASE WHEN slot % 17 <> 0 THEN CAST((slot * 133100 + satellite * 5300000) % 36000000 - 18000000 AS DOUBLE) / 100000 END AS lon"""
#: Ten samples before and after each event of a user, who stands for a satellite.
_SAMPLES = f"""
SELECT satellite, {_PLACES}
FROM (SELECT DISTINCT user_id AS satellite, CAST(floor({{epoch(ts)}} / {STEP}.0) AS BIGINT) + d AS slot FROM {{events}} CROSS JOIN (VALUES {_NEAR}) n(d)) s"""

_W, _S, _E, _N = BOX
_HALF = SWATH_KM / 2 / p.EARTH_KM


def _far(lat: str, lon: str, lat2: str, lon2: str) -> str:
    return f"2 * {p.EARTH_KM} * asin(sqrt(least(1, pow(sin(radians({lat2} - {lat}) / 2), 2) + cos(radians({lat})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon}) / 2), 2))))"


def _heading(lat: str, lon: str, lat2: str, lon2: str) -> str:
    d = f"radians({lon2} - {lon})"
    return f"atan2(sin({d}) * cos(radians({lat2})), cos(radians({lat})) * sin(radians({lat2})) - sin(radians({lat})) * cos(radians({lat2})) * cos({d}))"


def _edge(turn: str) -> str:
    """SQL: lat and lon, in ten-thousandths, of the swath's edge on one side."""
    up = f"(sin(radians(lat)) * cos({_HALF}) + cos(radians(lat)) * sin({_HALF}) * cos(h {turn}))"
    lon = f"degrees(radians(lon) + atan2(sin(h {turn}) * sin({_HALF}) * cos(radians(lat)), cos({_HALF}) - sin(radians(lat)) * {up})) + 180"
    return f"CAST(floor(degrees(asin({up})) * 10000 + 0.5) AS BIGINT) || ' ' || CAST(floor(({lon} - 360 * floor(({lon}) / 360) - 180) * 10000 + 0.5) AS BIGINT)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_SAMPLES, dealt by stretches of time as events, before the samples around them are listed; some stand twice."""
    events = spark_sql(spark, sf_dir, f"SELECT user_id AS satellite, CAST(floor({{epoch(ts)}} / {STEP}.0) AS BIGINT) AS slot FROM {{events}}")
    return spark_sql(spark, sf_dir, f"SELECT satellite, stretch, {_PLACES} FROM {{slots}}", slots=swath.dealt(events, 10))


@query("geo_46_swath_passes", f"""
WITH s AS MATERIALIZED ({_SAMPLES}),
c AS (SELECT *, {_far('lat', 'lon', f'least({_N}, greatest({_S}, lat))', f'least({_E}, greatest({_W}, lon))')} <= {SWATH_KM / 2} AS hit FROM s WHERE lat IS NOT NULL),
g AS (SELECT *, t_s - {STEP} * row_number() OVER (PARTITION BY satellite ORDER BY t_s) AS island FROM c WHERE hit),
r AS (SELECT satellite, min(t_s) AS a, max(t_s) AS b FROM g GROUP BY satellite, island),
e AS (SELECT satellite, min(t_s) AS lo, max(t_s) AS hi FROM s GROUP BY satellite),
t AS (SELECT r.satellite, r.a, r.b, s.t_s, s.lat, s.lon, lead(s.lat) OVER o AS lat2, lead(s.lon) OVER o AS lon2, lag(s.lat) OVER o AS lat0, lag(s.lon) OVER o AS lon0, count(*) OVER (PARTITION BY r.satellite, r.a) AS n
      FROM r JOIN e ON e.satellite = r.satellite AND r.a > e.lo AND r.b < e.hi JOIN s ON s.satellite = r.satellite AND s.t_s BETWEEN r.a - {STEP} AND r.b + {STEP} AND s.lat IS NOT NULL
      WINDOW o AS (PARTITION BY r.satellite, r.a ORDER BY s.t_s)),
h AS (SELECT *, CASE WHEN lat2 IS NOT NULL THEN {_heading('lat', 'lon', 'lat2', 'lon2')} ELSE {_heading('lat0', 'lon0', 'lat', 'lon')} END AS h, {_far('lat', 'lon', str((_S + _N) / 2), str((_W + _E) / 2))} AS far FROM t WHERE n >= 2),
x AS (SELECT *, {_edge('- pi() / 2')} AS l, {_edge('+ pi() / 2')} AS r FROM h)
SELECT satellite, a AS start_s, arg_min(t_s, (far, t_s)) AS mid_s, b AS end_s, CAST(count(*) AS INT) AS points,
       CAST(floor(least({_N} - 0.2, greatest({_S} + 0.2, arg_min(lat, (far, t_s)))) * 10000 + 0.5) AS BIGINT) AS label_lat_e4, CAST(floor(least({_E} - 0.2, greatest({_W} + 0.2, arg_min(lon, (far, t_s)))) * 10000 + 0.5) AS BIGINT) AS label_lon_e4,
       string_agg(l, ',' ORDER BY t_s) || ',' || string_agg(r, ',' ORDER BY t_s DESC) || ',' || first(l ORDER BY t_s) AS ring
FROM x GROUP BY satellite, a, b""")
def swath_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passes of satellites over the region, each with the ring of its swath."""
    found = swath.passes(samples(spark, sf_dir), BOX, SWATH_KM, STEP)
    e4 = lambda x: F.floor(x * 10000 + 0.5).cast("long")
    ring = F.array_join(F.transform("ring", lambda x: F.concat_ws(" ", e4(x["lat"]), e4(x["lon"]))), ",")
    return found.select("satellite", "start_s", "mid_s", "end_s", F.size("track").alias("points"), e4(F.col("label.lat")).alias("label_lat_e4"), e4(F.col("label.lon")).alias("label_lon_e4"), ring.alias("ring"))


#: Groups, pixels of a block's side, and what shares sum to.
GROUPS, FACTOR, SCALE = 4, 4, 10
#: Lines as pixels: parts from north to south, suppliers and line numbers from west to east; a line without discount is of no group.
_PIXELS = """
SELECT l_partkey AS row, l_suppkey * 8 + l_linenumber AS col, l_quantity AS weight,
       CASE WHEN l_discount = 0 THEN NULL WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'R' THEN 1 WHEN l_linestatus = 'O' THEN 2 ELSE 3 END AS "group" FROM {lineitem}"""
_MIXED = f"""
WITH p AS MATERIALIZED ({_PIXELS}), size AS (SELECT max(row) // {FACTOR} + 1 AS high, max(col) // {FACTOR} + 1 AS wide FROM p),
w AS (SELECT row // {FACTOR} AS r, col // {FACTOR} AS c, g.g, sum(CASE WHEN p."group" = g.g THEN weight ELSE 0 END) AS w FROM p CROSS JOIN range({GROUPS}) g(g) WHERE p."group" IS NOT NULL GROUP BY 1, 2, 3),
x AS (SELECT *, w * {SCALE} / sum(w) OVER (PARTITION BY r, c) AS x FROM w),
q AS (SELECT *, floor(x) AS f, row_number() OVER (PARTITION BY r, c ORDER BY x - floor(x) DESC, g) AS place, {SCALE} - sum(floor(x)) OVER (PARTITION BY r, c) AS spare FROM x),
k AS (SELECT r, c, string_agg(CAST(CAST(f AS BIGINT) + CASE WHEN place <= spare THEN 1 ELSE 0 END AS VARCHAR), ',' ORDER BY g) AS key FROM q GROUP BY r, c),
b AS (SELECT r.r, c.c, coalesce(k.key, '') AS key FROM size CROSS JOIN LATERAL (SELECT unnest(range(high)) AS r) r CROSS JOIN LATERAL (SELECT unnest(range(wide)) AS c) c LEFT JOIN k ON k.r = r.r AND k.c = c.c),
names AS (SELECT key, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, key) - 1 AS index FROM b GROUP BY key)"""


def _down_sampled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pixels = spark_sql(spark, sf_dir, _PIXELS.replace('"group"', "`group`"))
    far = pixels.agg(F.max("row"), F.max("col")).first()
    return mixture.down_sampled(pixels, GROUPS, FACTOR, SCALE, (far[0] or 0) + 1, (far[1] or 0) + 1)


def _text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda x: F.concat_ws("x", x["index"], x["length"])), " ")


@query("add_46_mixture_rows", f"""{_MIXED},
m AS (SELECT b.r, b.c, names.index, CASE WHEN lag(names.index) OVER (PARTITION BY b.r ORDER BY b.c) = names.index THEN 0 ELSE 1 END AS fresh FROM b JOIN names ON names.key = b.key),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY c) AS run FROM m), runs AS (SELECT r, run, any_value(index) AS index, count(*) AS length FROM n GROUP BY r, run)
SELECT r AS row, string_agg(index || 'x' || length, ' ' ORDER BY run) AS runs FROM runs GROUP BY r""")
def mixture_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the coarser grid as runs of mixtures, empty ones too."""
    return _down_sampled(spark, sf_dir)[0].withColumn("runs", _text(F.col("runs")))


@query("add_46_mixtures", f"{_MIXED} SELECT index, key, n FROM names")
def mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary of mixtures, the most frequent first."""
    return _down_sampled(spark, sf_dir)[1]
