"""Event scores: features of an event's detections, a linear predictor in fixed order, a sigmoid, a bucket."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline import params as p
from emberline.functions.geo import planar_km, within_km


def family(source: Column) -> Column:
    return F.when(source.startswith("viirs"), "viirs").when(source.startswith("geo"), "geo").otherwise(source)


def platform(source: Column) -> Column:
    return F.when(source == "modis", "terra_aqua").when(source.startswith("viirs_"), F.substring(source, 7, 20)).when(source.startswith("geo_"), F.substring(source, 5, 20)).otherwise("sentinel3")


def prior(source: Column, confidence: Column, day_night: Column) -> Column:
    """How likely a detection is a fire, by source, confidence and day or night (unknown: day)."""
    fam, night = family(source), F.coalesce(day_night == "N", F.lit(False))
    out = F.lit(None).cast("double")
    for (f, c), (day, dark) in p.PRIORS.items():
        out = F.when((fam == f) & ((confidence == c) if c != "any" else F.lit(True)), F.when(night, dark).otherwise(day)).otherwise(out)
    return out


def overpass(source: Column, acq_s: Column, day_night: Column) -> Column:
    """Scanning sources: platform, UTC day and phase; geostationary ones share buckets of three hours."""
    phase = F.when(day_night == "N", "night").when(day_night == "D", "day").otherwise("unknown")
    geo = F.concat_ws("|", F.lit("geo"), F.floor(acq_s / (p.GEO_BUCKET_H * 3600)).cast("string"))
    return F.when(source.startswith("geo"), geo).otherwise(F.concat_ws("|", platform(source), F.floor(acq_s / 86400).cast("string"), phase))


def water_guard(over_water: Column, day_night: Column, confidence: Column) -> Column:
    """Rows over water that are daytime and low-confidence count for nothing."""
    return over_water.eqNullSafe(True) & day_night.eqNullSafe("D") & confidence.eqNullSafe("low")


def coherent(detections: DataFrame, event: str) -> DataFrame:
    """Events with three distinct points of one overpass that lie pairwise close: event, coherent.

    An overpass with fewer than three points has none, so most are dropped as they are dealt.  The others' points meet in cells
    as wide as the bound, each with what lies north of it or beside it, since a pair counts once.
    """
    points = detections.select(event, "overpass", "lat_e5", "lon_e5").repartition(event, "overpass").distinct()
    points = points.withColumn("_n", F.count("*").over(Window.partitionBy(event, "overpass"))).filter("_n > 2").drop("_n").withColumns({"lat": F.col("lat_e5") / 100000, "lon": F.col("lon_e5") / 100000})
    row, column = F.floor(F.col("lat") * 100).cast("long"), F.floor(F.col("lon") * 100).cast("long")
    points = points.withColumns({"r": row, "c": column})
    near = lambda x, south: F.explode(F.sequence(x - south, x + 1))  # noqa: E731  cells of 0.01 degree hold 0.75 km in one step north, and in one east
    probe = points.select(event, "overpass", "lat_e5", "lon_e5", "lat", "lon", near(F.col("r"), 0).alias("r"), "c").select("*", near(F.col("c"), 1).alias("c2")).drop("c").withColumnRenamed("c2", "c")
    other = points.select(event, "overpass", F.col("lat_e5").alias("lat2_e5"), F.col("lon_e5").alias("lon2_e5"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"), "r", "c")
    later = (F.col("lat2_e5") > F.col("lat_e5")) | ((F.col("lat2_e5") == F.col("lat_e5")) & (F.col("lon2_e5") > F.col("lon_e5")))
    pairs = probe.join(other, [event, "overpass", "r", "c"]).filter(later & within_km(planar_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), p.COHERENT_KM))
    a = F.struct("lat_e5", "lon_e5")
    b = F.struct(F.col("lat2_e5").alias("lat_e5"), F.col("lon2_e5").alias("lon_e5"))
    ab = pairs.select(event, "overpass", a.alias("a"), b.alias("b"))
    bc = ab.select(event, "overpass", F.col("a").alias("b"), F.col("b").alias("c"))
    ac = ab.select(event, "overpass", "a", F.col("b").alias("c"))
    return ab.join(bc, [event, "overpass", "b"]).join(ac, [event, "overpass", "a", "c"], "left_semi").select(event).distinct().withColumn("coherent", F.lit(True))


def features(detections: DataFrame, event: str) -> DataFrame:
    """One row of features for each event; events whose rows are all guarded away have none."""
    d = detections.filter(~water_guard(F.col("over_water"), F.col("day_night"), F.col("confidence")))
    scanning = ~F.col("source").startswith("geo")
    nadir = F.when(F.col("source").startswith("viirs"), 0.375 * 0.375).otherwise(1.0)
    edge = scanning & F.coalesce(F.col("scan_km") * F.col("track_km") > 2 * nadir, F.lit(False))
    d = d.withColumns({"overpass": overpass(F.col("source"), F.col("acq_s"), F.col("day_night")), "prior": prior(F.col("source"), F.col("confidence"), F.col("day_night")), "platform": platform(F.col("source"))})
    one = d.groupBy(event).agg(
        F.max("prior").alias("best"), F.count_distinct("overpass").alias("overpasses"), F.count_distinct("platform").alias("platforms"), F.bool_or(F.col("day_night") == "N").alias("night"), F.max("frp").alias("max_frp"),
        (F.count_if(scanning) > 0).alias("some_scanning"), (F.count_if(scanning & ~edge) == 0).alias("no_inner"), F.bool_and((F.col("day_night") == "D") & (F.col("confidence") == "low")).alias("glint"), F.count("*").alias("rows"),
    )
    flag = lambda c: c.cast("double")
    frp = F.coalesce(F.least(F.log1p(F.greatest("max_frp", F.lit(0.0))) / F.log1p(F.lit(p.FRP_SATURATION)), F.lit(1.0)), F.lit(0.0))
    return one.join(coherent(d, event), event, "left").select(
        event, "rows", "best", (F.least(F.col("overpasses") - 1, F.lit(p.OVERPASS_CAP)) / p.OVERPASS_CAP).alias("persist"), flag(F.col("platforms") >= 2).alias("multisource"), flag(F.coalesce("night", F.lit(False))).alias("night"),
        flag(F.coalesce("coherent", F.lit(False))).alias("coherence"), frp.alias("frp"), flag(F.col("some_scanning") & F.col("no_inner")).alias("edge"), flag(F.coalesce("glint", F.lit(False))).alias("glint"),
    )


def linear() -> Column:
    """The model's linear score of a row of features."""
    terms = [F.lit(p.WEIGHTS["intercept"]), *[F.col(k) * w for k, w in p.WEIGHTS.items() if k != "intercept"]]
    return reduce(lambda a, b: a + b, terms)


def score(features: DataFrame) -> DataFrame:
    """score_e6 (the sigmoid in whole millionths) and bucket of each row of features."""
    e6 = F.floor(1e6 / (1 + F.exp(-linear())) + 0.5).cast("long")
    return features.withColumn("score_e6", e6).withColumn("bucket", F.when(F.col("score_e6") >= p.CONFIRMED * 1e6, "confirmed").when(F.col("score_e6") >= p.LIKELY * 1e6, "likely").otherwise("unverified"))
