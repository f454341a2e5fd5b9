"""Writers: partitions replaced under guard, keyed upserts, and exports whose lines Spark makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from emberline.functions.text import csv_cell, label_escape, xml_escape


def promote(staged: DataFrame, where: str, partition: str, least_rows: int = 1) -> dict:
    """Replace the staged partitions of a table, if the staged rows are sane: enough of them, and no uid twice in a partition."""
    sane = staged.groupBy(partition, "uid").count().agg(F.sum("count").alias("rows"), F.count_if(F.col("count") > 1).alias("repeated")).first()
    rows, repeated = sane["rows"] or 0, sane["repeated"] or 0
    if rows < least_rows or repeated:
        return {"promoted": False, "rows": rows, "repeated": repeated}
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(where)
    return {"promoted": True, "rows": rows, "repeated": repeated}


def upserted(held: DataFrame, incoming: DataFrame, keys: list[str], sticky: list[str] = ()) -> DataFrame:
    """Held rows with the incoming ones over them; sticky columns keep the held value where the incoming one is null."""
    new = incoming.select(*keys, F.struct(*[c for c in held.columns if c not in keys]).alias("_new"))
    both = held.select(*keys, F.struct(*[c for c in held.columns if c not in keys]).alias("_old")).join(new, keys, "full_outer")

    def own(c: str) -> Column:
        fresh = F.coalesce(F.col(f"_new.{c}"), F.col(f"_old.{c}")) if c in sticky else F.col(f"_new.{c}")
        return F.when(F.col("_new").isNull(), F.col(f"_old.{c}")).otherwise(fresh).alias(c)

    return both.select(*[F.col(c) if c in keys else own(c) for c in held.columns])


def geojson_lines(events: DataFrame, properties: list[str]) -> DataFrame:
    """line: one GeoJSON point feature (as newline-delimited GeoJSON) of each row with lon and lat; keys in order of name."""
    props = F.struct(*[F.col(c) for c in sorted(properties)])
    geometry = F.struct(F.array("lon", "lat").alias("coordinates"), F.lit("Point").alias("type"))
    return events.select(F.to_json(F.struct(geometry.alias("geometry"), props.alias("properties"), F.lit("Feature").alias("type")), {"ignoreNullFields": "false"}).alias("line"))


def csv_lines(events: DataFrame, columns: list[str]) -> DataFrame:
    """line: the cells of each row, quoted where needed and formulas disarmed; header_lines stands before them."""
    return events.select(F.concat_ws(",", *[csv_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]).alias("line"))


def header_lines(notes: list[str], columns: list[str]) -> str:
    """What a CSV document begins with: a byte order mark, notes, names, each line ended by CR LF."""
    return "﻿" + "".join(f"# {n}\r\n" for n in notes) + ",".join(columns) + "\r\n"


def kml_lines(events: DataFrame, name: str, description: str) -> DataFrame:
    """line: one placemark of each row."""
    at = F.concat_ws(",", F.format_string("%.5f", "lon"), F.format_string("%.5f", "lat"))
    return events.select(F.concat(F.lit("<Placemark><name>"), xml_escape(F.col(name).cast("string")), F.lit("</name><description>"), xml_escape(F.coalesce(F.col(description).cast("string"), F.lit(""))), F.lit("</description><Point><coordinates>"), at, F.lit("</coordinates></Point></Placemark>")).alias("line"))


def exposition_lines(samples: DataFrame) -> DataFrame:
    """family, place, line of metric samples (family, help, kind, labels map, value): two comment lines, then samples in order of their labels."""
    labels = F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit('="'), label_escape(e["value"]), F.lit('"'))))
    inner = F.array_join(labels, ",")
    rows = samples.select("family", F.lit(2).alias("place"), F.concat(F.col("family"), F.when(inner == "", "").otherwise(F.concat(F.lit("{"), inner, F.lit("}"))), F.lit(" "), F.col("value").cast("string")).alias("line"))
    heads = samples.groupBy("family").agg(F.min("help").alias("help"), F.min("kind").alias("kind"))
    return heads.select("family", F.lit(0).alias("place"), F.concat(F.lit("# HELP "), "family", F.lit(" "), "help").alias("line")).unionAll(heads.select("family", F.lit(1).alias("place"), F.concat(F.lit("# TYPE "), "family", F.lit(" "), "kind").alias("line"))).unionAll(rows).orderBy("family", "place", "line")


def canonical_json(rows: DataFrame, column: str) -> Column:
    """JSON with the fields of all structs in order of name and nulls written, so that equal values have equal texts."""

    def ordered(kind: DataType, value: Column) -> Column:
        if isinstance(kind, StructType):
            return F.struct(*[ordered(f.dataType, value[f.name]).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        if isinstance(kind, ArrayType):
            return F.transform(value, lambda v: ordered(kind.elementType, v))
        return value

    return F.to_json(ordered(rows.schema[column].dataType, F.col(column)), {"ignoreNullFields": "false"})
