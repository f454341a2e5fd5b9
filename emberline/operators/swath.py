"""Passes of a swath over a box, from samples of the point below a satellite.

Samples (satellite, t_s, lat, lon) stand ``step_s`` seconds apart; one without a position covers nothing.  A pass is a run
of consecutive samples whose swath reaches the box, with one sample more at each end; what touches the first or last
sample of a satellite isn't whole, so it is none.

Samples are dealt once, by satellite and stretch of time, and put in order there, so that equal ones count once.  What covers
or stands beside what covers is written as a table, with the first and last of each stretch; the rest, nearly all, is never
shuffled again.  Pieces of runs are joined where stretches meet, so a satellite's runs are in one task but never its samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline import params as p
from emberline.functions.geo import haversine_km
from emberline.operators.graph import pieces, written

#: Samples in a stretch; how far a label stays from the box's sides, in degrees.
STRETCH, LABEL_INSET = 2048, 0.2


def _between(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def covers(lat: Column, lon: Column, box: tuple[float, float, float, float], swath_km: float) -> Column:
    """Whether half a swath reaches the nearest point of the box (west, south, east, north); without a position, no."""
    west, south, east, north = map(float, box)
    far = haversine_km(lat, lon, _between(lat, south, north), _between(lon, west, east))
    return lat.isNotNull() & lon.isNotNull() & (far <= swath_km / 2)


def bearing(a: Column, b: Column) -> Column:
    """Radians from north, clockwise, of the great circle that leaves ``a`` for ``b``."""
    la, lb, d = F.radians(a["lat"]), F.radians(b["lat"]), F.radians(b["lon"] - a["lon"])
    return F.atan2(F.sin(d) * F.cos(lb), F.cos(la) * F.sin(lb) - F.sin(la) * F.cos(lb) * F.cos(d))


def beside(point: Column, heading: Column, km: float) -> Column:
    """The place (lat, lon) so far from a point along a heading."""
    arc, la = km / p.EARTH_KM, F.radians(point["lat"])
    up = F.sin(la) * F.cos(F.lit(arc)) + F.cos(la) * F.sin(F.lit(arc)) * F.cos(heading)
    turn = F.atan2(F.sin(heading) * F.sin(F.lit(arc)) * F.cos(la), F.cos(F.lit(arc)) - F.sin(la) * up)
    lon = F.pmod(F.degrees(F.radians(point["lon"]) + turn) + 180, F.lit(360.0)) - 180
    return F.struct(F.degrees(F.asin(up)).alias("lat"), lon.alias("lon"))


def dealt(slots: DataFrame, reach: int) -> DataFrame:
    """satellite, stretch, slot: the slots within so many of each of the given (satellite, slot), dealt before they are listed; some stand twice."""
    stretches = F.sequence(F.floor((F.col("slot") - reach) / STRETCH).cast("long"), F.floor((F.col("slot") + reach) / STRETCH).cast("long"))
    rows = slots.select("satellite", "slot", F.explode(stretches).alias("stretch")).repartition(pieces(slots, 1), "satellite", "stretch")
    every = rows.select("satellite", "stretch", F.explode(F.sequence(F.col("slot") - reach, F.col("slot") + reach)).alias("slot"))
    return every.filter(F.floor(F.col("slot") / STRETCH) == F.col("stretch"))


def near(samples: DataFrame, box: tuple[float, float, float, float], swath_km: float, step_s: int) -> DataFrame:
    """satellite, stretch, slot, lat, lon, hit of samples that cover, are next to one that does, or are the first or last of their stretch.

    Samples with a column ``stretch``, as of ``dealt``, are taken as dealt by it.
    """
    slot = F.floor(F.col("t_s") / step_s).cast("long")
    if "stretch" in samples.columns:
        rows = samples.select("satellite", "stretch", slot.alias("slot"), "lat", "lon")
    else:
        rows = samples.select("satellite", F.floor(slot / STRETCH).cast("long").alias("stretch"), slot.alias("slot"), "lat", "lon").repartition("satellite", "stretch")
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    rows = rows.withColumns({c: F.when(known, F.col(c)) for c in ("lat", "lon")})
    part = Window.partitionBy("satellite", "stretch")
    again = F.lag("slot").over(part.orderBy("slot", F.asc_nulls_last("lat"), F.asc_nulls_last("lon"))) == F.col("slot")
    once = rows.withColumn("_again", F.coalesce(again, F.lit(False))).filter(~F.col("_again")).drop("_again").withColumn("hit", covers(F.col("lat"), F.col("lon"), box, swath_km))
    order = part.orderBy("slot")
    beside = [(F.lag(c).over(order), F.lead(c).over(order)) for c in ("slot", "hit")]
    (before, after), (hit_before, hit_after) = beside
    wanted = F.col("hit") | before.isNull() | after.isNull() | (hit_before & (before == F.col("slot") - 1)) | (hit_after & (after == F.col("slot") + 1))
    return once.withColumn("_wanted", wanted).filter("_wanted").drop("_wanted")


def runs(found: DataFrame) -> DataFrame:
    """satellite, first, last slot of covering runs that touch neither end of the satellite's samples; of what ``near`` found."""
    island = F.col("slot") - F.row_number().over(Window.partitionBy("satellite", "stretch").orderBy("slot"))
    pieces = found.filter("hit").withColumn("_i", island).groupBy("satellite", "stretch", "_i").agg(F.min("slot").alias("_a"), F.max("slot").alias("_b"))
    order = Window.partitionBy("satellite").orderBy("_a")
    begins = F.when(F.col("_a") == F.lag("_b").over(order) + 1, 0).otherwise(1)
    whole = pieces.withColumn("_new", begins).withColumn("_run", F.sum("_new").over(order)).groupBy("satellite", "_run").agg(F.min("_a").alias("first"), F.max("_b").alias("last"))
    ends = found.groupBy("satellite").agg(F.min("slot").alias("_least"), F.max("slot").alias("_most"))
    return whole.join(ends, "satellite").filter("first > _least AND last < _most").select("satellite", "first", "last")


def passes(samples: DataFrame, box: tuple[float, float, float, float], swath_km: float, step_s: int, window: tuple[int, int] | None = None) -> DataFrame:
    """satellite, start_s, mid_s, end_s, label, track, left, right, ring of every pass, or of those whose middle is in the window.

    The middle is the sample nearest the box's centre, the first of such; the label is there, moved into the box.  ``left``
    and ``right`` are the swath's edges beside each point of the track, by the direction of flight; ``ring`` is left, then
    right backwards, then its first point again.  A track of one point is no pass; equal samples count once.
    """
    west, south, east, north = map(float, box)
    found = written(near(samples, box, swath_km, step_s), "swath")
    time = lambda k: (F.col(k) * step_s).cast("long")
    wanted = runs(found).select("satellite", time("first").alias("first_t"), time("last").alias("last_t"), F.explode(F.sequence(F.col("first") - 1, F.col("last") + 1)).alias("slot"))
    far = haversine_km(F.col("lat"), F.col("lon"), F.lit((south + north) / 2), F.lit((west + east) / 2))
    placed = found.filter("lat IS NOT NULL").select("satellite", "slot", time("slot").alias("t_s"), "lat", "lon", far.alias("_far"))
    points = wanted.join(placed, ["satellite", "slot"]).groupBy("satellite", "first_t", "last_t").agg(
        F.array_sort(F.collect_list(F.struct("t_s", "lat", "lon"))).alias("track"), F.min(F.struct("_far", "t_s", "lat", "lon")).alias("_mid"))
    at = F.col("track")
    size = F.size(at)
    ahead = lambda x, i: F.when(i < size - 1, bearing(x, F.get(at, i + 1))).otherwise(bearing(F.get(at, i - 1), x))
    flown = points.filter(size >= 2).withColumn("_way", F.transform(at, lambda x, i: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"), ahead(x, i).alias("h"))))
    edge = lambda turn: F.transform("_way", lambda x: beside(x, x["h"] + turn, swath_km / 2))
    quarter = F.pi() / 2
    edged = flown.withColumn("left", edge(-quarter)).withColumn("right", edge(quarter))
    label = F.struct(_between(F.col("_mid.lat"), south + LABEL_INSET, north - LABEL_INSET).alias("lat"), _between(F.col("_mid.lon"), west + LABEL_INSET, east - LABEL_INSET).alias("lon"))
    ring = F.concat(F.col("left"), F.reverse("right"), F.slice("left", 1, 1))
    out = edged.select("satellite", F.col("first_t").alias("start_s"), F.col("_mid.t_s").alias("mid_s"), F.col("last_t").alias("end_s"), label.alias("label"), "track", "left", "right", ring.alias("ring"))
    return out if window is None else out.filter((F.col("mid_s") >= window[0]) & (F.col("mid_s") < window[1]))
