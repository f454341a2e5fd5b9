"""Explanations of differences, read strictly: a closed set of fields, keys that stand once, and the place of the first fault.

A body is ``{"explanations": [{"key", "disposition", "fixtureId"?, "reason"}]}``.  Bodies are parsed and checked row by row;
only keys are shuffled, to see which stand twice, and one fault for each faulty entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS, DISPOSITIONS = ["key", "disposition", "fixtureId", "reason"], ["fixture", "accepted"]


def _is(value: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit(kind)), F.lit(False))


def _string(value: Column) -> Column:
    """The value of a string that isn't blank, else null."""
    text = F.when(_is(value, "STRING"), F.try_variant_get(value, "$", "string"))
    return F.when(~text.rlike(r"(?U)^[\s﻿]*$"), text)


def _unknown(text: Column, allowed: list[str]) -> Column:
    return F.get(F.filter(F.json_object_keys(text), lambda k: ~k.isin(allowed)), 0)


def checked(bodies: DataFrame, id_: str) -> DataFrame:
    """id, index, key, disposition, fixture_id, reason, fault: every entry, and a row without index for each body that has a fault of its own.

    ``fault`` is the place and what is wrong there, of the first rule that an entry breaks, null if none.  A null body,
    one that isn't JSON (a field twice in an object isn't) or isn't an object is a fault; an empty list is none, and has
    no rows.  What is blank counts as empty.
    """
    parsed = bodies.select(id_, "body", F.try_parse_json("body").alias("_v"))
    listed = parsed.withColumns({"_list": F.try_variant_get("_v", "$.explanations", "variant"), "_extra": F.when(_is(F.col("_v"), "OBJECT"), _unknown(F.col("body"), ["explanations"]))})
    own = (F.when(~_is(F.col("_v"), "OBJECT"), "explanations: not an object")
           .when(F.col("_extra").isNotNull(), F.concat(F.lit("explanations."), "_extra", F.lit(": unknown field")))
           .when(~_is(F.col("_list"), "ARRAY"), "explanations.explanations: not an array"))
    listed = listed.withColumn("_fault", own)
    raw = F.from_json("body", "explanations array<string>")["explanations"]
    pairs = F.when(F.col("_fault").isNull(), F.arrays_zip(F.try_variant_get("_list", "$", "array<variant>").alias("v"), raw.alias("text")))
    entries = listed.filter("_fault IS NULL").select(id_, F.posexplode(pairs).alias("index", "_e")).select(id_, "index", F.col("_e.v").alias("_v"), F.col("_e.text").alias("_text"))
    field = lambda name: F.when(_is(F.col("_v"), "OBJECT"), F.try_variant_get("_v", f"$.{name}", "variant"))
    entries = entries.withColumns({f"_{name}": field(name) for name in FIELDS})
    entries = entries.withColumns({"_object": _is(F.col("_v"), "OBJECT"), "key": _string(F.col("_key")), "disposition": _string(F.col("_disposition")), "reason": _string(F.col("_reason")), "fixture_id": _string(F.col("_fixtureId"))})
    entries = entries.withColumns({"_extra": F.when(F.col("_object"), _unknown(F.col("_text"), FIELDS)), "_told": F.col("_fixtureId").isNotNull() & ~F.is_variant_null("_fixtureId")}).drop("_v", "_text", *[f"_{name}" for name in FIELDS])
    first = F.min("index").over(Window.partitionBy(id_, "key"))
    known = F.coalesce(F.col("disposition").isin(DISPOSITIONS), F.lit(False))
    fault = (F.when(~F.col("_object"), ": not an object")
             .when(F.col("_extra").isNotNull(), F.concat(F.lit("."), "_extra", F.lit(": unknown field")))
             .when(F.col("key").isNull(), ".key: empty")
             .when(F.col("index") > first, ".key: repeated")
             .when(~known, ".disposition: neither fixture nor accepted")
             .when(F.col("reason").isNull(), ".reason: empty")
             .when((F.col("disposition") == "fixture") & F.col("fixture_id").isNull(), ".fixtureId: empty")
             .when((F.col("disposition") == "accepted") & F.col("_told"), ".fixtureId: for fixtures alone"))
    told = entries.withColumn("fault", F.concat(F.lit("explanations["), F.col("index"), F.lit("]"), fault))
    columns = [id_, "index", "key", "disposition", "fixture_id", "reason", "fault"]
    none = listed.filter("_fault IS NOT NULL").select(id_, *[F.lit(None).cast("int" if c == "index" else "string").alias(c) for c in columns[1:-1]], F.col("_fault").alias("fault"))
    return told.select(*columns).unionByName(none)


def faults(rows: DataFrame, id_: str) -> DataFrame:
    """id, fault: the first of each faulty body, of the rows of ``checked``."""
    return rows.filter("fault IS NOT NULL").groupBy(id_).agg(F.min_by("fault", F.coalesce("index", F.lit(-1))).alias("fault"))


def explanations(rows: DataFrame, id_: str) -> DataFrame:
    """id, key, disposition, fixture_id, reason of bodies without a fault; one fault refuses the whole body."""
    return rows.join(faults(rows, id_).select(F.col(id_).alias("_bad")), F.col(id_).eqNullSafe(F.col("_bad")), "left_anti").select(id_, "key", "disposition", "fixture_id", "reason")
