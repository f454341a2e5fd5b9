"""Readers: files of the domain to rows, by Spark's own sources; a bad row becomes a rejected row, a bad header an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions.text import canonical_acq_iso, canonical_degrees, detection_uid
from emberline.sources import documents

#: The columns of an active-fire file, read as text so that a bad cell rejects its row alone.
CSV_COLUMNS = "latitude string, longitude string, bright_ti4 string, scan string, track string, acq_date string, acq_time string, satellite string, confidence string, version string, bright_ti5 string, frp string, daynight string"
REQUIRED = ["latitude", "longitude", "acq_date", "acq_time", "satellite", "confidence", "daynight", "frp", "scan", "track"]


def active_fire_csv(spark: SparkSession, path: str) -> DataFrame:
    """The file's rows as text.  A missing required column fails the whole file; names decide, not places."""
    rows = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", True).csv(path)
    named = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
    if missing := [c for c in REQUIRED if c not in named.columns]:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return named


def confidence_class(raw: Column) -> Column:
    """l, n, h, or a whole number of 0 to 100 (under 30, under 80); null for anything else."""
    number = F.when(raw.rlike(r"^\d{1,3}$"), raw.cast("int"))
    return F.when(raw == "l", "low").when(raw == "n", "nominal").when(raw == "h", "high").when(number < 30, "low").when(number < 80, "nominal").when(number <= 100, "high")


def detections_of(rows: DataFrame, source: str) -> DataFrame:
    """Archive rows of an active-fire file's (with available_s): canonical place and time, the uid made of them, and what couldn't be read as null."""
    lat, lon, iso = canonical_degrees(F.trim("latitude")), canonical_degrees(F.trim("longitude")), canonical_acq_iso(F.trim("acq_date"), F.trim("acq_time"))
    brightness = next((c for c in ("bright_ti4", "brightness") if c in rows.columns), None)
    number = lambda c: F.trim(c).try_cast("double")
    return rows.select(
        detection_uid(F.lit(source), iso, lat, lon).alias("uid"), F.lit(source).alias("source"), F.unix_seconds(F.try_to_timestamp(iso)).alias("acq_s"), "available_s",
        lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), F.round(lat.cast("decimal(10,5)") * 100000).cast("long").alias("lat_e5"), F.round(lon.cast("decimal(10,5)") * 100000).cast("long").alias("lon_e5"),
        number("frp").alias("frp"), confidence_class(F.trim("confidence")).alias("confidence"), F.when(F.trim("daynight").isin("D", "N"), F.trim("daynight")).alias("day_night"),
        number("scan").alias("scan_km"), number("track").alias("track_km"), (number(brightness) if brightness else F.lit(None).cast("double")).alias("brightness_k"),
    )


def parsed(rows: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """(detections, rejected rows): a row without a readable place, time or confidence is rejected as a whole."""
    d = detections_of(rows, source)
    ok = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("acq_s").isNotNull() & F.col("confidence").isNotNull()
    return d.filter(ok), d.filter(~ok)


def availability_csv(spark: SparkSession, path: str) -> DataFrame:
    """product (lower case), first_day, last_day; unreadable dates are null."""
    rows = spark.read.option("header", True).csv(path)
    return rows.select(F.lower("data_id").alias("product"), F.col("min_date").try_cast("date").alias("first_day"), F.col("max_date").try_cast("date").alias("last_day"))


def index_lines(spark: SparkSession, path: str, step: str, names: list[str]) -> DataFrame:
    """param, offset, length: of a JSON-lines index the first surface entry of each wanted parameter at a step; bad lines are skipped."""
    lines = spark.read.text(path).withColumn("_at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    e = lines.select("_at", F.from_json("value", "levtype string, step string, param string, _offset long, _length long").alias("e")).filter((F.col("e.levtype") == "sfc") & (F.col("e.step") == step) & F.col("e.param").isin(names))
    return e.groupBy(F.col("e.param").alias("param")).agg(F.min_by(F.struct("e._offset", "e._length"), "_at").alias("first")).select("param", F.col("first._offset").alias("offset"), F.col("first._length").alias("length"))


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path).withColumnRenamed("value", "body")


def atom_feed(spark: SparkSession, path: str) -> DataFrame:
    """id, title, updated, usable of each entry of the feeds in a folder."""
    return documents.feed_entries(_documents(spark, path))


def cap_alerts(spark: SparkSession, path: str) -> DataFrame:
    """identifier, language, event, severity, onset, expires, area of each info block and area of the alerts in a folder."""
    return documents.alert_areas(_documents(spark, path))


def perimeters(features: DataFrame) -> DataFrame:
    """id, area_ha, start, end, rings, reject of GeoJSON features (column feature, one JSON each); reject names the first rule broken, of copies of an id all but one."""
    schema = "properties struct<id: string, area_ha: double, firedate: string, lastupdate: string>, geometry struct<type: string, coordinates: array<array<array<double>>>>"
    f = features.select("feature", F.from_json("feature", schema).alias("f")).select("feature", "f.*")
    start, end = F.to_timestamp(F.col("properties.firedate").try_cast("timestamp")), F.to_timestamp(F.col("properties.lastupdate").try_cast("timestamp"))
    rows = f.select("feature", F.col("properties.id").alias("id"), F.col("properties.area_ha").alias("area_ha"), start.alias("start"), end.alias("end"), F.when(F.col("geometry.type") == "Polygon", F.col("geometry.coordinates")).alias("rings"))
    rule = F.when(F.col("id").isNull(), "no_id").when(F.col("rings").isNull(), "no_polygon").when(F.col("area_ha").isNull() | (F.col("area_ha") <= 0), "no_area").when(F.col("start").isNull() | F.col("end").isNull() | (F.col("end") < F.col("start")), "bad_date")
    rows = rows.withColumn("reject", rule)
    first = rows.filter("reject IS NULL").groupBy("id").agg(F.min("feature").alias("_first"))
    joined = rows.join(first, "id", "left")
    numbered = joined.withColumn("reject", F.when(F.col("reject").isNull() & (F.col("feature") != F.col("_first")), "duplicate_id").otherwise(F.col("reject")))
    return numbered.select("id", "area_ha", "start", "end", "rings", "reject")


def activations(spark: SparkSession, path: str) -> DataFrame:
    """code, category, lon, lat, box of the activations in a folder's pages."""
    return documents.activations(_documents(spark, path))


def replay_batches(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """batch, place, detectionUid, source, acqTsIso, available_at: detections of ordered poll files; one without an arrival inherits the file's.  ``lines``: a poll a line."""
    schema = "availableAt string, detections array<struct<detectionUid: string, source: string, acqTsIso: string, latCanonical: string, lonCanonical: string, confidence: string, frpMw: double, dayNight: string, availableAt: string>>"
    b = spark.read.schema(schema).option("multiLine", not lines).json(path).select(F.col("_metadata.file_name").alias("batch"), "availableAt", F.posexplode("detections").alias("place", "d"))
    return b.select("batch", "place", "d.detectionUid", "d.source", "d.acqTsIso", "d.latCanonical", "d.lonCanonical", "d.confidence", "d.frpMw", "d.dayNight", F.coalesce("d.availableAt", "availableAt").alias("available_at"))


def places_tsv(spark: SparkSession, path: str) -> DataFrame:
    """place_id, name, lat, lon, population of a headless tab-separated file by the places of its columns."""
    rows = spark.read.option("sep", "\t").option("quote", "").csv(path)
    at = lambda i, kind: F.col(rows.columns[i]).try_cast(kind)
    return rows.select(at(0, "long").alias("place_id"), F.col(rows.columns[1]).alias("name"), at(4, "double").alias("lat"), at(5, "double").alias("lon"), at(14, "long").alias("population"))
