"""The reference mask of static sources: files read strictly, indexed by cells, and kept as a dimension with a version.

A file is one JSON object with format, version, licence, attribution, scale, kinds and sources; a source is
``[kind, x, y, dx, dy, ...]``, whole numbers in parts of ``scale`` of a degree, each place told from the one before; one
place is a point, three or more a ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.sources import archive

#: Degrees of a cell's side.
SIDE = 0.02
_LARGEST = float(2**53 - 1)


def _kind(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _number(value: Column) -> Column:
    """A whole number, else null."""
    x = F.when(_kind(value).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(value, "$", "double"))
    return F.when((x == F.floor(x)) & (F.abs(x) <= _LARGEST), x).cast("long")


def read(bodies: DataFrame, id_: str, tag: str, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """Sources (id, version, digest, index, kind, west, south, east, north, vertices in degrees) of bodies without a fault, and id, fault of the others.

    The fault is the first: of the header's fields in their order, then of the sources.  A null body, or one that isn't
    JSON, is "not an object".  An empty list of sources is no fault.
    """
    v = bodies.select(id_, F.sha2("body", 256).alias("digest"), F.try_parse_json("body").alias("_v"))
    of = lambda name: F.try_variant_get("_v", f"$.{name}", "variant")
    text = lambda name: F.when(_kind(of(name)) == "STRING", F.try_variant_get("_v", f"$.{name}", "string"))
    empty = lambda name: F.coalesce(text(name), F.lit("")) == ""
    scale, listed = _number(of("scale")), of("sources")
    named = F.when(_kind(of("kinds")).startswith("ARRAY"), F.try_variant_get("_v", "$.kinds", "array<string>"))
    fault = F.when(~_kind(F.col("_v")).startswith("OBJECT"), "not an object").when(~F.coalesce(text("format") == tag, F.lit(False)), "format")
    for name in ("version", "licence", "attribution"):
        fault = fault.when(empty(name), name)
    fault = fault.when(scale.isNull() | (scale <= 0), "scale").when(~F.coalesce(named == F.array(*map(F.lit, kinds)), F.lit(False)), "kinds").when(~_kind(listed).startswith("ARRAY"), "sources")
    head = v.select(id_, "digest", text("version").alias("version"), scale.alias("_scale"), listed.alias("_list"), fault.alias("_fault"))
    entries = head.filter("_fault IS NULL").select(id_, "digest", "version", "_scale", F.posexplode(F.try_variant_get("_list", "$", "array<variant>")).alias("index", "_e"))
    entries = entries.withColumn("_n", F.when(_kind(F.col("_e")).startswith("ARRAY"), F.transform(F.try_variant_get("_e", "$", "array<variant>"), _number)))
    size, chosen = F.size("_n"), F.get(F.array(*map(F.lit, kinds)), F.get("_n", F.lit(0)).cast("int"))
    shape = F.when(F.col("_n").isNull() | (size < 3), "not a source").when(chosen.isNull(), "unknown kind").when(size % 2 == 0, "an odd number of coordinates").when(size == 5, "two places")
    entries = entries.withColumns({"kind": chosen, "_shape": shape}).drop("_e")
    # Places by running sums, row by row, so that a ring of any length takes time in proportion.
    steps = F.transform(F.sequence(F.lit(1), F.when(F.col("_shape").isNull(), size - 2).otherwise(1), F.lit(2)), lambda i: F.struct(F.get("_n", i).alias("dx"), F.get("_n", i + 1).alias("dy")))
    places = entries.select(id_, "digest", "version", "_scale", "index", "kind", "_shape", F.posexplode(steps).alias("_i", "_d"))
    along = Window.partitionBy(id_, "index").orderBy("_i")
    whole = F.max(F.when(F.col("_d.dx").isNull() | F.col("_d.dy").isNull(), 1).otherwise(0)).over(along) == 0
    degrees = lambda c: F.when(whole, F.sum(f"_d.{c}").over(along) / F.col("_scale"))
    places = places.withColumns({"lon": degrees("dx"), "lat": degrees("dy")})
    off = (F.abs("lon") > 180) | (F.abs("lat") > 90)
    told = places.groupBy(id_, "index").agg(
        *[F.first(c).alias(c) for c in ("digest", "version", "kind", "_shape")], F.max(F.coalesce(off, F.lit(False))).alias("_off"), F.max(F.col("lon").isNull()).alias("_part"),
        *[f(c).alias(a) for f, c, a in ((F.min, "lon", "west"), (F.min, "lat", "south"), (F.max, "lon", "east"), (F.max, "lat", "north"))],
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "lon", "lat"))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("vertices"))
    wrong = F.coalesce(F.col("_shape"), F.when(F.col("_off"), "off the globe").when(F.col("_part"), "a coordinate that isn't whole"))
    told = told.withColumn("_wrong", wrong)
    bad = told.filter("_wrong IS NOT NULL").groupBy(id_).agg(F.min(F.struct("index", "_wrong")).alias("_w")).select(id_, F.concat(F.lit("sources["), "_w.index", F.lit("]: "), "_w._wrong").alias("fault"))
    bad = bad.unionByName(head.filter("_fault IS NOT NULL").select(id_, F.col("_fault").alias("fault")))
    good = told.join(bad.select(F.col(id_).alias("_bad")), F.col(id_).eqNullSafe(F.col("_bad")), "left_anti")
    return good.select(id_, "version", "digest", "index", "kind", "west", "south", "east", "north", "vertices"), bad


def indexed(sources: DataFrame, side: float = SIDE) -> DataFrame:
    """The sources with their cells (r, c): once for each cell that their box touches."""
    cells = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / side), F.floor(F.col(high) / side)))
    return sources.withColumn("r", cells("south", "north")).withColumn("c", cells("west", "east"))


def store(sources: DataFrame, root: str) -> str:
    """Make one file's sources the mask that is in force: "stored", or "unchanged" where it is already.

    Verdicts name the version that they rest on, so other bytes under the version in force are refused, and so are rows
    of several files or of none; what is in force then stays.
    """
    spark = sources.sparkSession
    told = sources.select("version", "digest").distinct().limit(2).collect()
    if len(told) != 1:
        raise ValueError("a mask is the sources of one file")
    held = in_force(spark, root)
    if held and held["digest"] == told[0]["digest"]:
        return "unchanged"
    if held and held["version"] == told[0]["version"]:
        raise ValueError(f"other bytes under version {held['version']}")
    archive.publish(indexed(sources), root)
    return "stored"


def in_force(spark: SparkSession, root: str):
    """version, digest of the mask in force, or None."""
    try:
        return archive.current(spark, root, check=False).select("version", "digest").first()
    except ValueError:
        return None


def load(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The mask in force with its cells; an error where none is, where its files were changed, or where it isn't this version."""
    held = archive.current(spark, root)
    if version is not None and (now := held.select("version").first()["version"]) != version:
        raise ValueError(f"the mask in force is version {now}, not {version}")
    return held
