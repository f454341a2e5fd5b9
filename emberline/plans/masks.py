"""Masks of static sources: a file of fifty parts each, some with a fault, read strictly and indexed by cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.plans.catalog import query
from emberline.plans.polygons import _SOURCES, static_sources
from emberline.sources import mask

TAG, KINDS = "static-sources@1", ["solar", "industrial", "flare"]
#: What stands in place of the source of the part with this remainder by fifty, by the file's number modulo 16.
FAULTY, ENTRIES = 17, {1: "[9, 1, 2]", 2: "[0, 1]", 3: "[0, 1, 2, 3]", 4: "[0, 1, 2, 3, 4]", 5: "[0, 1.5, 2]", 6: "[0, 36000000, 0]", 7: '"x"', 12: "[2, 2400000, 3900000.0]"}
TOLD = {1: "unknown kind", 2: "not a source", 3: "an odd number of coordinates", 4: "two places", 5: "a coordinate that isn''t whole", 6: "off the globe", 7: "not a source"}
#: Faults of the header, by the same number.
HEADS = {8: "scale", 9: "kinds", 10: "version", 11: "format"}


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, body."""
    number = F.floor(F.col("source") / 50).cast("long")
    ring = F.col("rings")[0]
    step = lambda v, i, c: v[c] - F.when(i > 0, F.get(ring, i - 1)[c]).otherwise(0)
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1
    good = F.concat(F.lit("["), F.array_join(F.concat(F.array(kind.cast("long")), F.flatten(F.transform(ring, lambda v, i: F.array(step(v, i, "x"), step(v, i, "y"))))), ", "), F.lit("]"))
    instead = F.when(F.col("source") % 50 == FAULTY, F.get(F.array(*[F.lit(ENTRIES.get(k)) for k in range(16)]), (F.col("file") % 16).cast("int")))
    told = static_sources(spark, sf_dir).withColumn("file", number).select("file", "source", F.coalesce(instead, good).alias("entry"))
    listed = told.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", "entry"))), lambda s: s["entry"]), ", ").alias("_list"))
    k = F.col("file") % 16
    has = lambda bad, ill, well: F.when(k == bad, ill).otherwise(well)
    parts = [F.lit('{"format": "'), has(11, "other@1", TAG), F.lit('", '), F.when(k == 10, F.lit("")).otherwise(F.concat(F.lit('"version": "v'), F.col("file"), F.lit('", '))), F.lit('"licence": "open", "attribution": "all", "kinds": '),
             has(9, '["solar"]', '["solar", "industrial", "flare"]'), F.lit(', "scale": '), has(8, "0", "100000"), F.lit(', "sources": ['), F.col("_list"), F.lit("]}")]
    return listed.select("file", F.concat(*parts).alias("body"))


_CASES = " ".join(f"WHEN {k} THEN '{v}'" for k, v in HEADS.items()) + " " + " ".join(f"WHEN {k} THEN 'sources[' || place || ']: {v}'" for k, v in TOLD.items())
_FILES = f"""
WITH {_SOURCES}, n AS (SELECT p_partkey AS key, p_partkey // 50 AS file, row_number() OVER (PARTITION BY p_partkey // 50 ORDER BY p_partkey) - 1 AS index FROM {{part}}),
f AS (SELECT file, max(CASE WHEN key % 50 = {FAULTY} THEN index END) AS place FROM n GROUP BY file), told AS (SELECT file, CASE file % 16 {_CASES} END AS fault FROM f)"""


@query("src_45_mask_faults", f"{_FILES} SELECT file, fault FROM told WHERE fault IS NOT NULL")
def mask_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fault of each faulty file."""
    return mask.read(files(spark, sf_dir), "file", TAG, KINDS)[1]


@query("src_45_reference_mask", f"""{_FILES},
b AS (SELECT n.file, n.index, n.key, CASE WHEN w.w THEN 'flare' ELSE CASE n.key % 3 WHEN 0 THEN 'solar' WHEN 1 THEN 'industrial' ELSE 'flare' END END AS kind, CASE WHEN w.w THEN 2400000 ELSE min(ax) END AS x0, CASE WHEN w.w THEN 2400000 ELSE max(ax) END AS x1, CASE WHEN w.w THEN 3900000 ELSE min(ay) END AS y0, CASE WHEN w.w THEN 3900000 ELSE max(ay) END AS y1
      FROM n JOIN told ON told.file = n.file AND told.fault IS NULL JOIN sides ON sides.key = n.key CROSS JOIN LATERAL (SELECT n.file % 16 = 12 AND n.key % 50 = {FAULTY} AS w) w GROUP BY n.file, n.index, n.key, w.w),
r AS (SELECT *, CAST(floor(y0 / 100000.0::DOUBLE / {mask.SIDE}::DOUBLE) AS BIGINT) AS r0, CAST(floor(y1 / 100000.0::DOUBLE / {mask.SIDE}::DOUBLE) AS BIGINT) AS r1, CAST(floor(x0 / 100000.0::DOUBLE / {mask.SIDE}::DOUBLE) AS BIGINT) AS c0, CAST(floor(x1 / 100000.0::DOUBLE / {mask.SIDE}::DOUBLE) AS BIGINT) AS c1 FROM b),
rows AS (SELECT *, unnest(range(r0, r1 + 1)) AS r FROM r)
SELECT 'v' || file AS version, CAST(index AS INT) AS index, kind, r, unnest(range(c0, c1 + 1)) AS c FROM rows""")
def reference_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source of the files without a fault, by cells."""
    return mask.indexed(mask.read(files(spark, sf_dir), "file", TAG, KINDS)[0]).select("version", "index", "kind", "r", "c")
