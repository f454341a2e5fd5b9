"""Explanations of differences, a body for each customer with an entry for each order, some of every fault."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import annotations
from emberline.plans.catalog import query, spark_sql

#: Entries as text: well formed, or faulty by the number of the order.
_ENTRY = """CASE
  WHEN o_orderkey % 300 = 0 THEN '7'
  WHEN o_orderkey % 300 = 1 THEN '{"key": "a", "fixtureID": "S17", "also": 1, "disposition": "accepted", "reason": "r"}'
  WHEN o_orderkey % 300 = 2 THEN '{"key": "  ", "disposition": "accepted", "reason": "r"}'
  WHEN o_orderkey % 300 = 3 THEN '{"key": 5, "disposition": "accepted", "reason": "r"}'
  ELSE concat('{"reason": ', CASE o_orderkey % 300 WHEN 4 THEN '" "' WHEN 5 THEN '12' ELSE '"seen \\u00e9 \\"twice\\""' END, ', "key": "diff:', CAST(o_orderkey * 7919 % 1000 AS VARCHAR(20)),
    '"', CASE o_orderkey % 300 WHEN 6 THEN ', "disposition": "maybe"' WHEN 7 THEN '' WHEN 8 THEN ', "disposition": "fixture"' WHEN 9 THEN ', "disposition": "accepted", "fixtureId": "S3"'
      WHEN 10 THEN ', "disposition": "fixture", "fixtureId": null' ELSE CASE o_orderkey % 3 WHEN 0 THEN ', "fixtureId": "S17", "disposition": "fixture"' WHEN 1 THEN ', "disposition": "accepted", "fixtureId": null' ELSE ', "disposition": "accepted"' END END, '}') END"""
#: Bodies by customer, around the list.
_BEFORE = "CASE doc % 50 WHEN 0 THEN '{\"note\": [1], \"explanations\": [' WHEN 1 THEN '{\"explanations\": {\"x\": [' WHEN 2 THEN '[' WHEN 4 THEN '{' ELSE '{\"explanations\": [' END"
_AFTER = "CASE doc % 50 WHEN 1 THEN ']}}' WHEN 2 THEN ']' WHEN 3 THEN ']' WHEN 4 THEN '' ELSE ']}' END"
_BLANK = r"trim(coalesce({0}, ''), chr(32) || chr(9) || chr(10)) = ''"


def _word(name: str) -> str:
    return f"CASE WHEN json_type(e, '$.{name}') = 'VARCHAR' THEN json_extract_string(e, '$.{name}') END"


_READ = f"""
WITH bodies AS (SELECT doc, {_BEFORE} || string_agg(entry, ', ' ORDER BY k) || {_AFTER} AS body FROM (SELECT o_custkey AS doc, o_orderkey AS k, {_ENTRY} AS entry FROM {{orders}}) t GROUP BY doc),
j AS MATERIALIZED (SELECT doc, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM bodies),
own AS (SELECT doc, j, CASE WHEN j IS NULL OR json_type(j) <> 'OBJECT' THEN 'explanations: not an object'
  WHEN len(list_filter(json_keys(j), lambda x: x <> 'explanations')) > 0 THEN 'explanations.' || list_filter(json_keys(j), lambda x: x <> 'explanations')[1] || ': unknown field'
  WHEN coalesce(json_type(j, '$.explanations'), '') <> 'ARRAY' THEN 'explanations.explanations: not an array' END AS fault FROM j),
e AS (SELECT doc, i, json_extract(j, '$.explanations[' || i || ']') AS e FROM (SELECT doc, j, unnest(range(CAST(json_array_length(j, '$.explanations') AS BIGINT))) AS i FROM own WHERE fault IS NULL) t),
f AS (SELECT doc, i, e, CASE WHEN json_type(e) = 'OBJECT' THEN list_filter(json_keys(e), lambda x: x NOT IN ('key', 'disposition', 'fixtureId', 'reason'))[1] END AS extra,
  {_word('key')} AS key, {_word('disposition')} AS disposition, {_word('reason')} AS reason, {_word('fixtureId')} AS fixture_id, coalesce(json_type(e, '$.fixtureId'), 'NULL') <> 'NULL' AS told FROM e),
r AS (SELECT *, 'explanations[' || i || ']' || CASE WHEN json_type(e) <> 'OBJECT' THEN ': not an object' WHEN extra IS NOT NULL THEN '.' || extra || ': unknown field' WHEN {_BLANK.format('key')} THEN '.key: empty'
  WHEN EXISTS (SELECT 1 FROM f g WHERE g.doc = f.doc AND g.key = f.key AND g.i < f.i) THEN '.key: repeated' WHEN coalesce(disposition, '') NOT IN ('fixture', 'accepted') THEN '.disposition: neither fixture nor accepted'
  WHEN {_BLANK.format('reason')} THEN '.reason: empty' WHEN disposition = 'fixture' AND {_BLANK.format('fixture_id')} THEN '.fixtureId: empty' WHEN disposition = 'accepted' AND told THEN '.fixtureId: for fixtures alone' END AS fault FROM f),
bad AS (SELECT doc, arg_min(fault, i) AS fault FROM (SELECT doc, i, fault FROM r WHERE fault IS NOT NULL UNION ALL SELECT doc, -1, fault FROM own WHERE fault IS NOT NULL) t GROUP BY doc)"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = spark_sql(spark, sf_dir, "SELECT * FROM {orders}").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("k"), F.expr(_ENTRY.replace("\\", "\\\\")).alias("entry"))
    listed = entries.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "entry"))), lambda x: x["entry"]), ", ").alias("_list"))
    return annotations.checked(listed.select("doc", F.concat(F.expr(_BEFORE), "_list", F.expr(_AFTER)).alias("body")), "doc")


@query("udf_20_annotation_faults", f"{_READ} SELECT doc, fault FROM bad")
def annotation_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fault of each faulty body."""
    return annotations.faults(_checked(spark, sf_dir), "doc")


@query("udf_20_explanations", f"{_READ} SELECT doc, key, disposition, fixture_id, reason FROM r WHERE doc NOT IN (SELECT doc FROM bad)")
def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The explanations of bodies without a fault."""
    return annotations.explanations(_checked(spark, sf_dir), "doc")
