"""Queries of validation, filters and scalar functions of text and time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import text as t
from emberline.operators import ingest
from emberline.plans.catalog import both, frame, query
from emberline.plans.relational import DAY, NOW

_RULES = [
    ("outside_bbox", "NOT (lon BETWEEN 19.99 AND 31.01 AND lat BETWEEN 38.99 AND 46.01)"), ("future_acquisition", "acq_s > available_s + 300"),
    ("before_window", "acq_s < (available_s - 3600) - (available_s - 3600) % 86400 - 86400"), ("footprint", "NOT (scan_km > 0 AND scan_km <= 10 AND track_km > 0 AND track_km <= 10)"),
    ("negative_frp", "frp < 0"), ("brightness", "NOT (brightness_k BETWEEN 150 AND 600)"),
]


@query("flt_01_violations", "SELECT event_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {r} THEN '{c}' END" for c, r in _RULES) + "], lambda x: x IS NOT NULL), '|') AS codes FROM detections")
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.validated(frame(spark, sf_dir, "detections")).select("event_id", F.array_join("violations", "|").alias("codes"))


@query("flt_02_partition", "SELECT source, count(*) FILTER (WHERE NOT bad) AS accepted, count(*) FILTER (WHERE bad) AS rejected FROM (SELECT source, " + " OR ".join(f"({r})" for _, r in _RULES) + " AS bad FROM detections) d GROUP BY source")
def partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.size("violations") == 0
    return ingest.validated(frame(spark, sf_dir, "detections")).groupBy("source").agg(F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"))


@query("flt_07_link_distance", "SELECT event_id, CAST(floor(1e6 * CASE source WHEN 'modis' THEN greatest(3.0, 1.5 * sqrt(scan_km * track_km)) WHEN 'geo_msg' THEN 5.5 ELSE 1.25 END + 0.5) AS BIGINT) AS eps_e6 FROM detections")
def link_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "detections").select("event_id", F.floor(1e6 * ingest.link_distance_km() + 0.5).cast("long").alias("eps_e6"))


both("flt_03_window_start", "SELECT event_id, (available_s - 3600) - (available_s - 3600) % 86400 - 86400 AS window_s FROM detections")
both("flt_04_default_footprint", "SELECT event_id, coalesce(CASE WHEN event_id % 4 <> 0 THEN scan_km END, 1.0) AS scan_km, coalesce(CASE WHEN event_id % 6 <> 0 THEN track_km END, 2.0) AS track_km FROM detections")
both("flt_06_water_guard", "SELECT event_id, coalesce(over_water AND day_night = 'D' AND confidence = 'low', FALSE) AS dropped FROM detections")
both("flt_08_attach_only", "SELECT source, source = 'geo_msg' AS attach_only, count(*) AS n FROM detections GROUP BY source")
both("flt_09_flash_filter", "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'unrated' WHEN frp / 490 > 0.5 THEN 'dropped' ELSE 'kept' END AS verdict FROM detections")
both("flt_11_coverage_candidate", "SELECT fire_id FROM fires WHERE lon BETWEEN 23 - 0.5 AND 27 + 0.5 AND lat BETWEEN 41.5 - 0.3 AND 43.5 + 0.3")
both("flt_12_active_warnings", f"SELECT fire_id, started_s, status FROM fires WHERE last_s + 86400 > {NOW - 8 * DAY} ORDER BY CASE WHEN status = 'active' THEN 0 ELSE 1 END, n DESC, status, fire_id")
both("flt_13_composite", f"SELECT fire_id FROM fires WHERE ({NOW} - last_s <= {9 * DAY}) AND coalesce(CASE WHEN fire_id % 7 <> 0 THEN status <> 'archived' END, TRUE) AND coalesce(CASE WHEN fire_id % 5 <> 0 THEN score >= 0.3 END, TRUE)")
both("flt_14_buckets", f"SELECT CASE WHEN fire_id % 5 = 0 THEN 'filtered_out' WHEN {NOW} - last_s > {6 * DAY} THEN 'older' ELSE 'visible' END AS bucket, count(*) AS n FROM fires GROUP BY 1")
both("flt_16_sensitivity", "SELECT f.fire_id FROM fires f JOIN (SELECT fire_id, count(DISTINCT source) AS sensors FROM members GROUP BY fire_id) m ON m.fire_id = f.fire_id WHERE (CASE WHEN f.score >= 0.75 THEN 2 WHEN f.score >= 0.45 THEN 1 ELSE 0 END) >= 1 AND f.n >= 2 AND m.sensors >= 2")
both("flt_18_age", f"SELECT event_id FROM detections WHERE acq_s >= {NOW - 6 * DAY}")
both("flt_19_recent_and_older", f"SELECT count(*) FILTER (WHERE acq_s >= {NOW - 6 * DAY}) AS recent, count(*) FILTER (WHERE acq_s < {NOW - 6 * DAY}) AS older FROM detections")
both("flt_20_wrapping_box", "WITH b AS (SELECT * FROM (VALUES (1, 22.0, 25.0), (2, 27.0, 23.0)) AS t(box, west, east)) SELECT b.box, count(*) AS n FROM detections d JOIN b ON d.lat BETWEEN 41.5 AND 43.5 AND CASE WHEN b.west <= b.east THEN d.lon BETWEEN b.west AND b.east ELSE d.lon >= b.west OR d.lon <= b.east END GROUP BY b.box")
both("flt_21_in_view", "SELECT fire_id, CAST((lat_e5 - 4250000) AS BIGINT) * (lat_e5 - 4250000) + CAST((lon_e5 - 2550000) AS BIGINT) * (lon_e5 - 2550000) AS far FROM fires WHERE lat_e5 BETWEEN 4200000 AND 4300000 AND lon_e5 BETWEEN 2450000 AND 2650000")
both("flt_22_coverage", "SELECT event_id, lon BETWEEN 20 AND 31 AND lat BETWEEN 39 AND 46 AS inside FROM detections")
both("flt_29_deliverable", "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'missing_trigger' WHEN o_orderkey % 13 = 0 THEN 'missing_rule_version' WHEN o_orderkey % 7 = 0 AND o_orderkey % 2 = 0 THEN 'self_approval' ELSE 'ok' END AS verdict FROM {orders}")


@query("flt_15_families", "SELECT fire_id, CASE WHEN count(fam) > 0 THEN array_to_string(list_sort(list(DISTINCT fam)), '|') END AS families FROM (SELECT fire_id, CASE WHEN source LIKE 'viirs%' THEN 'viirs' WHEN source = 'modis' THEN 'modis' END AS fam FROM members) m GROUP BY fire_id")
def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    fam = F.when(F.col("source").startswith("viirs"), "viirs").when(F.col("source") == "modis", "modis")
    return frame(spark, sf_dir, "members").groupBy("fire_id").agg(F.collect_set(fam).alias("s")).select("fire_id", F.when(F.size("s") > 0, F.array_join(F.array_sort("s"), "|")).alias("families"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("fn_01_acquisition_iso", "SELECT event_id, CASE WHEN h % 100 < 60 AND h < 2400 THEN '2024-01-02T' || lpad(CAST(h // 100 AS VARCHAR), 2, '0') || ':' || lpad(CAST(h % 100 AS VARCHAR), 2, '0') || ':00Z' END AS iso FROM (SELECT event_id, event_id * 7 % 2500 AS h FROM detections) d")
def acquisition_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "detections").select("event_id", t.canonical_acq_iso(F.lit("2024-01-02"), F.col("event_id") * 7 % 2500).alias("iso"))


@query("fn_02_canonical_degrees", "SELECT event_id, CAST(CAST(lat_e5 AS DECIMAL(18, 0)) / 100000 AS DECIMAL(10, 5))::VARCHAR AS degrees FROM detections")
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat((F.col("lat_e5") / 100000).cast("decimal(10,5)").cast("string"), F.lit("49"))
    return frame(spark, sf_dir, "detections").select("event_id", t.canonical_degrees(text).alias("degrees"))


@query("fn_04_detection_uid", "SELECT event_id, sha256(source || '|' || CAST(acq_s AS VARCHAR) || '|' || CAST(lat_e5 AS VARCHAR) || '|' || CAST(lon_e5 AS VARCHAR)) AS uid FROM detections")
def uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "detections").select("event_id", t.detection_uid(F.col("source"), F.col("acq_s"), F.col("lat_e5"), F.col("lon_e5")).alias("uid"))


@query("fn_10_iso_week", "SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS week FROM orders")
def week(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", t.iso_week(F.to_date("o_orderdate")).alias("week"))


@query("fn_13_month_window", "SELECT o_orderkey, CAST(epoch(date_trunc('month', o_orderdate)) AS BIGINT) AS from_s, CAST(epoch(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH) AS BIGINT) AS to_s FROM orders")
def month(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.unix_timestamp(start).alias("from_s"), F.unix_timestamp(F.add_months(start, 1).cast("timestamp")).alias("to_s"))


both("fn_09_utc_day", "SELECT event_id, CAST(floor(acq_s / 86400.0) AS BIGINT) AS day FROM detections")
both("fn_14_history_window", "SELECT fire_id, hours, last_s - last_s % 600 - hours * 3600 AS from_s, last_s - last_s % 600 AS to_s FROM (SELECT fire_id, last_s, CASE fire_id % 3 WHEN 0 THEN 24 WHEN 1 THEN 72 ELSE 168 END AS hours FROM fires) h")
both("fn_15_quantised_coordinate", "SELECT event_id, CAST(floor(lat * 1000 + 0.5) AS BIGINT) AS lat_e3, CAST(floor(lon * 1000 + 0.5) AS BIGINT) AS lon_e3 FROM detections")
both("fn_36_backoff", "SELECT event_id, CAST(floor((event_id % 100) / 100.0 * least(60000, 500 * pow(2, event_id % 10))) AS BIGINT) AS delay_ms FROM detections")
both("fn_39_score_label", "SELECT fire_id, CASE WHEN score >= 0.75 THEN 'confirmed' WHEN score >= 0.45 THEN 'likely' ELSE 'unverified' END AS label FROM fires")
both("fn_40_replay_window", f"SELECT event_id, abs(acq_s - {NOW - 9 * DAY}) <= 300 AS fresh FROM detections")


@query("fn_24_redact", r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), 'eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+', '[jwt]', 'g')) AS digest FROM documents")
def redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.md5(t.redact(F.col("text"))).alias("digest"))


@query("fn_32_xml_escape", "SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS digest FROM documents")
def escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.md5(t.xml_escape(F.col("text"))).alias("digest"))


@query("fn_28_xml_round_trip", "SELECT doc_id, md5(text) AS digest FROM documents")
def unescape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", F.md5(t.xml_unescape(t.xml_escape(F.col("text")))).alias("digest"))


@query("fn_31_csv_cell", "SELECT page_id, CASE WHEN regexp_matches(s, '[\",\r\n]') THEN '\"' || replace(s, '\"', '\"\"') || '\"' ELSE s END AS cell FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '''=' || url WHEN page_id % 3 = 1 THEN url || ',\"x\"' ELSE url END AS s FROM pages) p")
def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("="), "url")).when(F.col("page_id") % 3 == 1, F.concat("url", F.lit(',"x"'))).otherwise(F.col("url"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", t.csv_cell(raw).alias("cell"))


#: The checksum by its table: 256 remainders, then a byte at a time.
_CRC = """
WITH t AS (SELECT list(c ORDER BY i) AS remainders FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i)) x),
h AS (SELECT page_id, hex(encode(html)) AS h FROM {pages}), b AS (SELECT page_id, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT) AS bytes FROM h)
SELECT page_id, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: xor(c >> 8, remainders[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM b CROSS JOIN t"""


@query("agg_52_crc32", _CRC)
def crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.crc32(F.col("html").cast("binary")).alias("crc"))


both("add_33_purge_plan", f"SELECT target, CASE WHEN days IS NULL THEN 'unarmed' WHEN days < 7 THEN 'below_floor' ELSE 'armed' END AS verdict, CASE WHEN days >= 7 THEN {NOW} - days * 86400 END AS cutoff_s FROM (SELECT s_suppkey AS target, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 31 END AS days FROM {{supplier}}) p")
both("add_47_worst_of", "SELECT CASE max(CASE WHEN level = 'outage' AND backup THEN 1 WHEN level = 'outage' THEN 2 WHEN level = 'degraded' THEN 1 ELSE 0 END) WHEN 2 THEN 'outage' WHEN 1 THEN 'degraded' ELSE 'ok' END AS overall FROM (SELECT CASE s_suppkey % 5 WHEN 0 THEN 'outage' WHEN 1 THEN 'degraded' ELSE 'ok' END AS level, s_suppkey % 5 = 0 AS backup FROM {supplier}) s")
both("udf_11_parameter_grid", "WITH e AS (SELECT DISTINCT 100 + p_size % 5 * 25 AS eps FROM {part}), l AS (SELECT DISTINCT 24 * (1 + p_partkey % 3) AS link_h FROM {part}), m AS (SELECT DISTINCT 250 + p_size % 3 * 50 AS modis FROM {part}) SELECT 'fixed' AS slice, eps, modis, link_h FROM e CROSS JOIN l CROSS JOIN m WHERE eps < modis UNION ALL SELECT 'footprint', eps, NULL, link_h FROM e CROSS JOIN l")
both("udf_22_retention", f"SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'unknown' ELSE CASE WHEN ({NOW} - at_s) / 86400.0 < CASE WHEN o_orderkey % 2 = 0 THEN 9500 ELSE 10500 END THEN 'keep' ELSE 'expire' END END AS verdict FROM (SELECT o_orderkey, o_orderpriority, {{epoch(o_orderdate)}} AS at_s FROM {{orders}}) o")
both("src_13_catch_up_slots", f"WITH s AS (SELECT source, max(acq_s) - max(acq_s) % 900 AS settled_s FROM detections WHERE acq_s < {NOW - 3 * DAY} GROUP BY source), k AS (SELECT * FROM (VALUES (1), (2), (3), (4), (5), (6)) AS t(k)) SELECT source, settled_s + k * 900 AS slot_s FROM s CROSS JOIN k WHERE settled_s + k * 900 <= {NOW}")
both("src_14_newest_slot", "SELECT event_id, (available_s - 1800) - (available_s - 1800) % 900 AS slot_s FROM detections")
both("src_33_point_scan", "SELECT event_id, CAST(regexp_extract(w, '[(](-?[0-9.]+) ', 1) AS DOUBLE) AS lon, CAST(regexp_extract(w, ' (-?[0-9.]+)[)]', 1) AS DOUBLE) AS lat FROM (SELECT event_id, concat('POINT(', CAST(lon AS VARCHAR(20)), ' ', CAST(lat AS VARCHAR(20)), ')') AS w FROM detections) d")
