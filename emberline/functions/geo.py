"""Column functions for places on the earth: planar and spherical distances, cells, boxes, bearings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberline import params as p


def quantize(x: Column, quantum: float = p.KM_QUANTUM) -> Column:
    """Whole quanta, halves up (so that <= is exact)."""
    return F.floor(x / quantum + 0.5).cast("long")


def planar_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on the plane of the region: a degree of longitude has its length at the mean latitude."""
    dy = (lat2 - lat1) * p.KM_LAT
    dx = (lon2 - lon1) * (F.lit(p.KM_LON) + p.KM_LON_SLOPE * ((lat1 + lat2) / 2 - p.REF_LAT))
    return F.sqrt(dx * dx + dy * dy)


def within_km(km: Column, bound: Column | float) -> Column:
    return quantize(km) <= quantize(bound if isinstance(bound, Column) else F.lit(bound))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * p.EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def bearing_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 to 360."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def compass(bearing: Column) -> Column:
    names = F.array(*[F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.element_at(names, (F.floor(bearing / 45 + 0.5) % 8 + 1).cast("int"))


def cell(lat: Column, lon: Column, per_degree: int = p.ZONE_CELLS) -> Column:
    """Grid cell key, row:column."""
    return F.concat_ws(":", F.floor(lat * per_degree).cast("long"), F.floor(lon * per_degree).cast("long"))


def cells_within(lat: Column, lon: Column, radius_km: Column, per_degree: int = p.ZONE_CELLS) -> Column:
    """All cells that a disc may touch, with a cell of slack on each side."""
    north = radius_km / p.KM_LAT
    widest = F.lit(p.KM_LON) + p.KM_LON_SLOPE * (F.abs(lat) + north - p.REF_LAT)
    east = radius_km / F.greatest(widest, F.lit(1.0))
    low = lambda x, d: F.floor((x - d) * per_degree).cast("long") - 1
    high = lambda x, d: F.floor((x + d) * per_degree).cast("long") + 1
    rows, columns = F.sequence(low(lat, north), high(lat, north)), F.sequence(low(lon, east), high(lon, east))
    return F.flatten(F.transform(rows, lambda r: F.transform(columns, lambda c: F.concat_ws(":", r, c))))


def coarse(x: Column, per_degree: int = p.COARSE_CELLS) -> Column:
    """The middle of a coordinate's coarse cell."""
    return (F.floor(x * per_degree) + 0.5) / per_degree


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float], slack: float = 0.0) -> Column:
    west, south, east, north = box
    return lon.between(west - slack, east + slack) & lat.between(south - slack, north + slack)


def in_wrapping_box(lon: Column, lat: Column, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Inclusive; a box whose west lies beyond its east wraps round the antimeridian."""
    return lat.between(south, north) & F.when(west <= east, lon.between(west, east)).otherwise((lon >= west) | (lon <= east))


def relative_position(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """km_e1 (tenths: whole kilometres from ten on, never under one tenth), compass, nearby of a place as seen from another."""
    km = haversine_km(lat1, lon1, lat2, lon2)
    tenths = F.when(km >= 10, F.floor(km + 0.5) * 10).otherwise(F.greatest(F.lit(1), F.floor(km * 10 + 0.5)))
    return F.struct(tenths.cast("long").alias("km_e1"), compass(bearing_degrees(lat1, lon1, lat2, lon2)).alias("compass"), (km < 1).alias("nearby"))


def widened(box: Column, km: Column) -> Column:
    """A box (west, south, east, north) with so many kilometres more on each side; degrees of longitude as at its widest latitude."""
    north = km / p.KM_LAT
    east = km / (p.KM_LAT * F.cos(F.radians(F.greatest(F.abs(box["south"]), F.abs(box["north"])))))
    return F.struct((box["west"] - east).alias("west"), (box["south"] - north).alias("south"), (box["east"] + east).alias("east"), (box["north"] + north).alias("north"))


def coarse_error_km(lat: Column, per_degree: int = p.COARSE_CELLS) -> Column:
    """Half a coarse cell's diagonal: the furthest a place is from its cell's middle."""
    step = p.KM_LAT / per_degree
    return F.sqrt(step * step + F.pow(step * F.cos(F.radians(lat)), F.lit(2))) / 2


def sun_elevation(lat: Column, lon: Column, at_s: Column) -> Column:
    """The sun's elevation in degrees, by the Astronomical Almanac's short formulas (good to a hundredth of a degree)."""
    n = at_s / 86400 - 10957.5  # days since noon of 2000-01-01
    g, mean = F.radians(357.528 + 0.9856003 * n), 280.46 + 0.9856474 * n
    along, tilt = F.radians(mean + 1.915 * F.sin(g) + 0.02 * F.sin(2 * g)), F.radians(23.439 - 0.0000004 * n)
    ascension, declination = F.atan2(F.cos(tilt) * F.sin(along), F.cos(along)), F.asin(F.sin(tilt) * F.sin(along))
    hour = F.radians(280.46061837 + 360.98564736629 * n + lon) - ascension
    return F.degrees(F.asin(F.sin(F.radians(lat)) * F.sin(declination) + F.cos(F.radians(lat)) * F.cos(declination) * F.cos(hour)))
