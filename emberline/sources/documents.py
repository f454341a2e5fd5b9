"""Readers of documents that are already rows (column body): JSON and XML bodies to rows.  A body of another shape gives none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.text import wkt_box, wkt_point


def feed_entries(bodies: DataFrame) -> DataFrame:
    """id, title, updated, usable of each entry of Atom feeds; an entry without id or title is not usable."""
    feeds = bodies.filter(F.col("body").rlike(r"(?s)^\s*(<\?xml[^>]*>)?\s*<feed[\s>]"))
    e = feeds.select(F.explode(F.from_xml("body", "entry array<struct<id: string, title: string, updated: string>>")["entry"]).alias("e"))
    return e.select("e.id", "e.title", F.try_to_timestamp("e.updated").alias("updated"), (F.col("e.id").isNotNull() & F.col("e.title").isNotNull()).alias("usable"))


def alert_areas(bodies: DataFrame) -> DataFrame:
    """identifier, language, event, severity, onset, expires, area of each info block and area of alerts that have an identifier."""
    schema = "identifier string, info array<struct<language: string, event: string, severity: string, onset: string, expires: string, area: array<struct<areaDesc: string>>>>"
    a = bodies.select(F.from_xml("body", schema).alias("a")).filter("a.identifier IS NOT NULL").select("a.identifier", F.explode_outer("a.info").alias("i"))
    return a.select("identifier", "i.language", "i.event", "i.severity", F.try_to_timestamp("i.onset").alias("onset"), F.try_to_timestamp("i.expires").alias("expires"), F.explode_outer("i.area.areaDesc").alias("area"))


def activations(bodies: DataFrame) -> DataFrame:
    """code, category, lon, lat, box of pages of a list of activations (WKT centroids and extents)."""
    schema = "results array<struct<code: string, category: string, centroid: string, extent: string>>"
    a = bodies.select(F.explode(F.from_json("body", schema)["results"]).alias("a")).select("a.*")
    lon, lat = wkt_point(F.col("centroid"))
    return a.select("code", "category", lon.alias("lon"), lat.alias("lat"), wkt_box(F.col("extent")).alias("box"))


def activation_products(bodies: DataFrame) -> DataFrame:
    """code, area, product of activations with their areas of interest and products."""
    schema = "code string, aois array<struct<name: string, products: array<struct<name: string>>>>"
    a = bodies.select(F.from_json("body", schema).alias("a")).filter("a.code IS NOT NULL").select("a.code", F.explode("a.aois").alias("o"))
    return a.select("code", F.col("o.name").alias("area"), F.explode("o.products.name").alias("product"))


def strict_rows(bodies: DataFrame, field: str, version: int, row: str) -> DataFrame:
    """The rows of bodies whose field has the known version; any other body is refused whole."""
    b = bodies.select(F.from_json("body", f"{field} int").alias("head"), "body").filter(F.col("head")[field] == version)
    fields = row.replace(" ", ": ").replace(",: ", ", ")
    return b.select(F.explode(F.from_json("body", f"rows array<struct<{fields}>>")["rows"]).alias("r")).select("r.*")


def pivoted(vectors: DataFrame, keys: Sequence[str], scaled: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows of parallel vectors: each value times its scale plus its offset.  Vectors of unequal lengths are an error."""
    sizes = [F.size(c) for c in scaled]
    same = F.lit(True)
    for s in sizes[1:]:
        same = same & (s == sizes[0])
    checked = vectors.withColumn("_z", F.when(same, F.arrays_zip(*scaled)).otherwise(F.raise_error(F.lit("vectors of unequal lengths"))))
    z = checked.select(*keys, F.explode("_z").alias("z"))
    return z.select(*keys, *[(F.col(f"z.{c}") * a + b).alias(c) for c, (a, b) in scaled.items()])


def point_features(bodies: DataFrame, properties: str) -> DataFrame:
    """lon, lat and properties of the points of feature collections; other geometries give no row."""
    fields = properties.replace(" ", ": ").replace(",: ", ", ")
    schema = f"type string, features array<struct<geometry: struct<type: string, coordinates: array<double>>, properties: struct<{fields}>>>"
    f = bodies.select(F.from_json("body", schema).alias("c")).filter("c.type = 'FeatureCollection'").select(F.explode("c.features").alias("f"))
    return f.filter("f.geometry.type = 'Point'").select(F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"), "f.properties.*")


def orbit_elements(bodies: DataFrame) -> DataFrame:
    """norad_id, epoch, mean_motion, eccentricity, inclination, usable: whether all lie where orbits can."""
    schema = "array<struct<NORAD_CAT_ID: long, EPOCH: string, MEAN_MOTION: double, ECCENTRICITY: double, INCLINATION: double>>"
    o = bodies.select(F.explode(F.from_json("body", schema)).alias("o")).select(F.col("o.NORAD_CAT_ID").alias("norad_id"), F.try_to_timestamp("o.EPOCH").alias("epoch"), F.col("o.MEAN_MOTION").alias("mean_motion"), F.col("o.ECCENTRICITY").alias("eccentricity"), F.col("o.INCLINATION").alias("inclination"))
    ok = F.col("norad_id").isNotNull() & F.col("epoch").isNotNull() & (F.col("mean_motion") > 0) & (F.col("eccentricity") >= 0) & (F.col("eccentricity") < 1) & F.col("inclination").between(0, 180)
    return o.withColumn("usable", F.coalesce(ok, F.lit(False)))


def coarse_lists(bodies: DataFrame, sources: Sequence[str]) -> DataFrame:
    """uid, source, acq_s of lists of detections of coarse sources, each uid once; a list with any other element is refused whole."""
    lists = bodies.select(F.from_json("body", "array<struct<uid: string, source: string, acq_s: long>>").alias("l"))
    good = lists.filter(F.forall("l", lambda d: d["uid"].isNotNull() & d["acq_s"].isNotNull() & d["source"].isin(list(sources))))
    return good.select(F.explode("l").alias("d")).select("d.*").groupBy("uid").agg(F.min(F.struct("acq_s", "source")).alias("d")).select("uid", "d.source", "d.acq_s")


def manifest_verdicts(jobs: DataFrame, version: int) -> DataFrame:
    """Jobs (body, digest, plan) with the first thing in which their manifest differs: version, digest, plan; or accepted."""
    m = jobs.withColumn("_m", F.from_json("body", "version int, digest string, plan string"))
    verdict = F.when(~F.col("_m.version").eqNullSafe(F.lit(version)), "version").when(~F.col("_m.digest").eqNullSafe(F.col("digest")), "digest").when(~F.col("_m.plan").eqNullSafe(F.col("plan")), "plan").otherwise("accepted")
    return m.withColumn("verdict", verdict).drop("_m")


def search_products(bodies: DataFrame) -> DataFrame:
    """product, size of pages of search results."""
    p = bodies.select(F.explode(F.from_json("body", "features array<struct<id: string, properties: struct<size: long>>>")["features"]).alias("p"))
    return p.select(F.col("p.id").alias("product"), F.col("p.properties.size").alias("size"))
