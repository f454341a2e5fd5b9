"""Aggregates, ordered analytics and state rules over the domain frames, as statements that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline import params as p
from emberline.plans.catalog import NEAR, both, near_zones, query, spark_sql
from emberline.plans.relational import DAY, NOW

# --- aggregates
both("agg_03_overpass_key", "SELECT event_id, CASE WHEN source = 'geo_msg' THEN concat('geo|', CAST(CAST(floor(acq_s / 10800.0) AS BIGINT) AS VARCHAR(20))) ELSE concat(CASE source WHEN 'modis' THEN 'terra_aqua' ELSE substring(source, 7, 10) END, '|', CAST(CAST(floor(acq_s / 86400.0) AS BIGINT) AS VARCHAR(20)), '|', CASE day_night WHEN 'N' THEN 'night' WHEN 'D' THEN 'day' ELSE 'unknown' END) END AS overpass FROM detections")
both("agg_04_mean_coordinate", "SELECT fire_id, CAST(floor(avg(lat_e5) + 0.5) AS BIGINT) AS lat_e5, CAST(floor(avg(lon_e5) + 0.5) AS BIGINT) AS lon_e5 FROM members GROUP BY fire_id")
both("agg_07_source_mix", "SELECT fire_id, source, count(*) AS n FROM members GROUP BY fire_id, source")
both("agg_09_refreshed_aggregates", "WITH a AS (SELECT fire_id, max(frp) AS max_frp, CAST(sum(CAST(floor(frp * 100 + 0.5) AS BIGINT)) AS BIGINT) AS frp_cents FROM members GROUP BY fire_id) SELECT f.fire_id, a.max_frp, a.frp_cents, f.lat_e5, f.lon_e5 FROM fires f JOIN a ON a.fire_id = f.fire_id")
both("agg_10_conditional_counts", "SELECT fire_id, count(*) AS members, count(*) FILTER (WHERE source <> 'geo_msg') AS non_geo, count(*) FILTER (WHERE day_night = 'N' AND confidence = 'high') AS night_high, count(DISTINCT source) AS sources FROM members GROUP BY fire_id")
both("agg_11_queue", "SELECT count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, count(*) FILTER (WHERE o_orderstatus = 'P') AS claimed, min(CASE WHEN o_orderstatus = 'O' THEN {epoch(o_orderdate)} END) AS oldest_s FROM {orders}")
both("agg_12_last_notified", "SELECT public_id, max(at_s) AS last_s FROM transitions GROUP BY public_id")
both("agg_13_watermark", "SELECT public_id, at_s, min(transition_id) AS first_id FROM transitions WHERE to_status IN ('F', 'P') AND public_id = 7 GROUP BY public_id, at_s ORDER BY at_s DESC LIMIT 1")
both("agg_14_count_by_key", "SELECT c_mktsegment AS key_id, count(*) AS n FROM {customer} GROUP BY c_mktsegment ORDER BY key_id")
both("agg_15_partition_sanity", "SELECT count(*) AS n, count(*) FILTER (WHERE lat IS NULL) AS unplaced, count(DISTINCT CAST(floor(acq_s / 86400.0) AS BIGINT)) AS days, count(*) - count(DISTINCT uid) AS repeated FROM detections")
_BATCHES = "SELECT source, available_s, count(*) * CASE WHEN available_s % 14400 = 0 THEN 30 ELSE 1 END AS n FROM detections GROUP BY source, available_s"


def trailing_breaker(batches: DataFrame, key: str, at: str, size: str, min_batch: int = p.BREAKER["min_batch"]) -> DataFrame:
    """Each batch with the number of earlier ones in its window (samples) and a verdict: over the median's multiple trips."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(-p.BREAKER["window"], -1)
    before = F.sort_array(F.collect_list(size).over(w))
    middle = lambda shift: F.element_at(before, F.floor((F.size(before) + shift) / 2).cast("int"))
    rows = batches.withColumn("samples", F.count(size).over(w)).withColumn("mid", F.when(F.col("samples") > 0, (middle(1) + middle(2)) / 2))
    verdict = F.when(F.col("samples") < p.BREAKER["min_samples"], "warming").when((F.col(size) >= min_batch) & (F.col(size) > p.BREAKER["ratio"] * F.col("mid")), "tripped").otherwise("passed")
    return rows.withColumn("verdict", verdict).drop("mid")


@query("agg_16_breaker", f"""
WITH batches AS ({_BATCHES}), before AS (SELECT *, count(*) OVER w AS samples, median(n) OVER w AS mid FROM batches WINDOW w AS (PARTITION BY source ORDER BY available_s ROWS BETWEEN {p.BREAKER['window']} PRECEDING AND 1 PRECEDING))
SELECT source, available_s, n, samples, CASE WHEN samples < {p.BREAKER['min_samples']} THEN 'warming' WHEN n >= 25 AND n > {p.BREAKER['ratio']} * mid THEN 'tripped' ELSE 'passed' END AS verdict FROM before""")
def _breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trailing_breaker(spark_sql(spark, sf_dir, _BATCHES), "source", "available_s", "n", min_batch=25)


both("agg_17_exact_median", "SELECT source, median(lag_s) AS median_s FROM lags GROUP BY source")
both("agg_18_histogram", f"SELECT source, CASE WHEN lag_s < 0 THEN -1 WHEN lag_s >= {120 * DAY} THEN 12 ELSE CAST(floor(lag_s / {10.0 * DAY}) AS BIGINT) END AS bucket, count(*) AS n, min(lag_s) AS lowest, max(lag_s) AS highest FROM lags GROUP BY 1, 2")
both("agg_20_daily_histogram", f"SELECT source, CAST(floor(available_s / {DAY}.0) AS BIGINT) AS day, CAST(floor(lag_s / {30.0 * DAY}) AS BIGINT) AS bucket, count(*) AS n FROM lags GROUP BY 1, 2, 3")
both("agg_22_histogram_quantile", f"""
WITH b AS (SELECT source, least(CAST(floor(lag_s / {10.0 * DAY}) AS BIGINT), 12) AS bucket, count(*) AS n, min(lag_s) AS lowest, max(lag_s) AS highest FROM lags GROUP BY 1, 2),
c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY source ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum, CAST(sum(n) OVER (PARTITION BY source) AS BIGINT) AS total, min(lowest) OVER (PARTITION BY source) AS lo, max(highest) OVER (PARTITION BY source) AS hi FROM b),
q AS (SELECT * FROM (VALUES (50), (90), (99)) AS t(pct))
SELECT source, pct, CAST(floor(greatest(bucket * {10 * DAY}, lo) + (least((bucket + 1) * {10 * DAY}, hi) - greatest(bucket * {10 * DAY}, lo)) * (pct / 100.0 * total - (cum - n)) / n + 0.5) AS BIGINT) AS lag_s
FROM c CROSS JOIN q WHERE pct / 100.0 * total > cum - n AND pct / 100.0 * total <= cum""")
both("agg_24_log_sketch", "SELECT source, CASE WHEN frp <= 0.1 THEN 0 ELSE 1 + CAST(floor(ln(frp / 0.1) / ln(1.05) + 0.000001) AS BIGINT) END AS bucket, count(*) AS n FROM detections GROUP BY 1, 2")
#: Each lag once, with the rank of its last row (r), its rows, and those of its source: a window over a source's lags, not its rows.
RANKED_LAGS = "WITH counts AS (SELECT source, lag_s, count(*) AS rows_ FROM lags GROUP BY source, lag_s), r AS (SELECT source, lag_s, CAST(sum(rows_) OVER (PARTITION BY source ORDER BY lag_s NULLS LAST) AS BIGINT) AS r, rows_, CAST(sum(rows_) OVER (PARTITION BY source) AS BIGINT) AS n FROM counts)"
_NEAREST_RANK = "WITH r AS (SELECT source, lag_s, row_number() OVER (PARTITION BY source ORDER BY lag_s) AS r, count(*) OVER (PARTITION BY source) AS n FROM lags), q AS (SELECT * FROM (VALUES (50), (95), (100)) AS t(pct)) SELECT source, pct, min(lag_s) AS value, max(n) AS n, max(CASE WHEN r = n THEN 1 ELSE 0 END) = 1 AS is_max FROM r CROSS JOIN q WHERE r = CAST(ceil(n * pct / 100.0) AS BIGINT) GROUP BY source, pct"
both("agg_26_nearest_rank", RANKED_LAGS + _NEAREST_RANK.removeprefix("WITH r AS (SELECT source, lag_s, row_number() OVER (PARTITION BY source ORDER BY lag_s) AS r, count(*) OVER (PARTITION BY source) AS n FROM lags)").replace("r = CAST(ceil(n * pct / 100.0) AS BIGINT)", "CAST(ceil(n * pct / 100.0) AS BIGINT) BETWEEN r - rows_ + 1 AND r"), _NEAREST_RANK)
both("agg_27_rate", "SELECT public_id, count(*) FILTER (WHERE state_rank = 2) AS numerator, count(*) FILTER (WHERE state_rank > 0) AS denominator, CAST(floor(1e9 * count(*) FILTER (WHERE state_rank = 2) / nullif(count(*) FILTER (WHERE state_rank > 0), 0) + 0.5) AS BIGINT) AS rate_e9 FROM transitions GROUP BY public_id")
both("agg_28_false_extinguish", f"""
WITH c AS (SELECT public_id, at_s, weight >= 200000 AS large, state_rank = 1 AS excluded, lead(at_s) OVER (PARTITION BY public_id ORDER BY at_s, transition_id) AS again_s FROM transitions),
s AS (SELECT 'overall' AS stratum, * FROM c UNION ALL SELECT CASE WHEN large THEN 'large' ELSE 'standard' END, * FROM c)
SELECT stratum, count(*) FILTER (WHERE NOT excluded) AS closures, count(*) FILTER (WHERE NOT excluded AND again_s - at_s <= {30 * DAY}) AS premature, count(*) FILTER (WHERE excluded) AS unobservable FROM s GROUP BY stratum""")
both("agg_29_flapping", f"""
WITH moves AS (SELECT public_id, at_s, transition_id, CAST(sign(state_rank - lag(state_rank) OVER (PARTITION BY public_id ORDER BY at_s, transition_id)) AS BIGINT) AS direction FROM transitions),
turns AS (SELECT public_id, at_s, direction <> lag(direction) OVER (PARTITION BY public_id ORDER BY at_s, transition_id) AS reversal FROM moves WHERE direction <> 0),
bursts AS (SELECT public_id, at_s - lag(at_s, 2) OVER (PARTITION BY public_id ORDER BY at_s) AS span_s FROM turns WHERE reversal)
SELECT t.public_id, count(*) FILTER (WHERE t.reversal) AS reversals, coalesce(max(CASE WHEN b.span_s <= {400 * DAY} THEN 1 ELSE 0 END), 0) = 1 AS flapping FROM (SELECT public_id, reversal FROM turns) t LEFT JOIN (SELECT public_id, min(span_s) AS span_s FROM bursts GROUP BY public_id) b ON b.public_id = t.public_id GROUP BY t.public_id""")
both("agg_30_duplicate_rate", f"WITH d AS (SELECT public_id, to_status, at_s - lag(at_s) OVER w AS since_s, weight > lag(weight) OVER w AS higher FROM transitions WINDOW w AS (PARTITION BY public_id, to_status ORDER BY at_s, transition_id)) SELECT to_status, count(*) AS alerts, count(*) FILTER (WHERE since_s < {60 * DAY} AND NOT higher) AS duplicates FROM d GROUP BY to_status")
both("agg_31_coverage", "WITH f AS (SELECT fire_id, n * 14 AS area_ha, fire_id % 3 <> 0 AS covered, fire_id % 2 = 0 AS alerted FROM fires), s AS (SELECT * FROM (VALUES (10), (50)) AS t(least_ha)) SELECT least_ha, count(*) AS perimeters, count(*) FILTER (WHERE covered AND alerted) AS hit FROM f JOIN s ON f.area_ha >= s.least_ha GROUP BY least_ha")
both("agg_32_stage_latency", "WITH t AS (SELECT event_id, available_s - acq_s AS arrival, event_id % 60 AS ingest, event_id % 13 AS decide FROM detections), u AS (SELECT 'arrival' AS stage, arrival AS s FROM t UNION ALL SELECT 'ingest', ingest FROM t UNION ALL SELECT 'decide', decide FROM t), r AS (SELECT stage, s, row_number() OVER (PARTITION BY stage ORDER BY s) AS r, count(*) OVER (PARTITION BY stage) AS n FROM u) SELECT stage, min(CASE WHEN r >= ceil(0.5 * n) THEN s END) AS p50, min(CASE WHEN r >= ceil(0.95 * n) THEN s END) AS p95, max(s) AS longest, count(*) AS n FROM r GROUP BY stage")
_PAIRS = """
WITH cells AS (SELECT user_id % 20 AS truth, fire_id % 15 AS found, count(*) AS n FROM members GROUP BY 1, 2), t AS (SELECT CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY truth), f AS (SELECT CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY found),
s AS (SELECT (SELECT CAST(sum(n * (n - 1)) AS DOUBLE) / 2 FROM cells) AS together, (SELECT CAST(sum(n * (n - 1)) AS DOUBLE) / 2 FROM t) AS same_truth, (SELECT CAST(sum(n * (n - 1)) AS DOUBLE) / 2 FROM f) AS same_found, (SELECT CAST(sum(n) AS DOUBLE) FROM cells) AS total)"""
both("agg_34_pair_counts", _PAIRS + " SELECT together, same_truth, same_found, CAST(floor(1e6 * together / nullif(same_truth, 0) + 0.5) AS BIGINT) AS recall_e6, CAST(floor(1e6 * together / nullif(same_found, 0) + 0.5) AS BIGINT) AS precision_e6 FROM s")
both("agg_35_adjusted_rand", _PAIRS + " SELECT CAST(floor(1e6 * (together - same_truth * same_found / (total * (total - 1) / 2)) / nullif((same_truth + same_found) / 2 - same_truth * same_found / (total * (total - 1) / 2), 0) + 0.5) AS BIGINT) AS ari_e6 FROM s")
both("agg_38_scope_by_stratum", "SELECT coalesce(source, 'all') AS scope, coalesce(confidence, 'all') AS stratum, count(*) AS n, CAST(grouping(source) + 2 * grouping(confidence) AS BIGINT) AS level FROM detections GROUP BY CUBE (source, confidence)")
_KINDS = "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN c = 0 THEN 'unlabeled' WHEN c = 1 THEN 'labeled' ELSE 'ambiguous' END AS kind FROM (SELECT d.event_id, count(f.fire_id) AS c FROM detections d LEFT JOIN fires f ON f.lat_e5 - f.lat_e5 % 10000 = d.lat_e5 - d.lat_e5 % 10000 AND f.lon_e5 - f.lon_e5 % 10000 = d.lon_e5 - d.lon_e5 % 10000 GROUP BY d.event_id) a) b GROUP BY kind"
# A cell's fires are counted before detections meet them, so each detection meets one row.
both("agg_39_label_kinds", "WITH k AS (SELECT lat_e5 - lat_e5 % 10000 AS y, lon_e5 - lon_e5 % 10000 AS x, count(fire_id) AS held FROM fires GROUP BY 1, 2) " + _KINDS.replace("count(f.fire_id) AS c", "coalesce(sum(f.held), 0) AS c").replace("fires f ON f.lat_e5 - f.lat_e5 % 10000", "k f ON f.y").replace("f.lon_e5 - f.lon_e5 % 10000", "f.x"), _KINDS)
both("agg_40_folded_states", "SELECT public_id, max(state_rank) AS state_rank, max(at_s) AS watermark_s, min(at_s) AS seeded_s, max_by(to_status, at_s * 10000000 + transition_id) AS latest FROM transitions GROUP BY public_id")
both("agg_41_facets", "SELECT family, count(DISTINCT fire_id) AS fires FROM (SELECT fire_id, CASE WHEN source LIKE 'viirs%' THEN 'viirs' WHEN source LIKE 'geo%' THEN 'geo' ELSE source END AS family FROM members) m GROUP BY family")
both("agg_42_preset_facets", "WITH f AS (SELECT f.fire_id, f.score, f.n, m.sources FROM fires f JOIN (SELECT fire_id, count(DISTINCT source) AS sources FROM members GROUP BY fire_id) m ON m.fire_id = f.fire_id) SELECT count(*) AS every, count(*) FILTER (WHERE score >= 0.45 AND n >= 2) AS balanced, count(*) FILTER (WHERE score >= 0.45 AND n >= 2 AND sources >= 2) AS multi FROM f")
both("agg_43_stale_sources", f"WITH limits AS (SELECT * FROM (VALUES ('viirs_snpp', 86400), ('modis', 432000), ('slstr', 86400)) AS t(source, limit_s)), l AS (SELECT source, max(acq_s) AS last_s FROM detections GROUP BY source) SELECT t.source, {NOW} - l.last_s AS age_s, l.last_s IS NULL OR {NOW} - l.last_s > t.limit_s AS stale FROM limits t LEFT JOIN l ON l.source = t.source")
both("agg_44_quiet_since", f"WITH l AS (SELECT source, max(acq_s) AS last_s FROM detections WHERE source LIKE 'viirs%' GROUP BY source) SELECT CASE WHEN bool_and({NOW} - last_s > 86400) THEN max(last_s) END AS quiet_since_s FROM l")
both("agg_45_status_roll_up", f"WITH l AS (SELECT source, max(acq_s) AS last_s FROM detections GROUP BY source), g AS (SELECT source, CASE WHEN last_s IS NULL THEN 0 WHEN {NOW} - last_s > {5 * DAY} THEN 4 WHEN {NOW} - last_s > {3 * DAY} THEN 3 ELSE 1 END AS grade FROM l) SELECT source, CASE grade WHEN 4 THEN 'critical' WHEN 3 THEN 'warn' WHEN 1 THEN 'ok' ELSE 'unknown' END AS status, CASE max(grade) OVER () WHEN 4 THEN 'critical' WHEN 3 THEN 'warn' ELSE 'ok' END AS worst FROM g")
both("agg_48_largest_remainder", """
WITH c AS (SELECT user_id % 30 AS cell, source, count(*) AS n FROM detections GROUP BY 1, 2), s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY cell) AS BIGINT) AS total FROM c),
q AS (SELECT *, CAST(floor(n * 100.0 / total) AS BIGINT) AS whole, n * 100 - CAST(floor(n * 100.0 / total) AS BIGINT) * total AS rest FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY rest DESC, source) AS r, 100 - CAST(sum(whole) OVER (PARTITION BY cell) AS BIGINT) AS missing FROM q)
SELECT cell, source, whole + CASE WHEN r <= missing THEN 1 ELSE 0 END AS share FROM r""")

# --- ordered analytics
both("win_01_session_ends", "SELECT user_id, acq_s AS end_s FROM (SELECT user_id, acq_s, lead(acq_s) OVER (PARTITION BY user_id ORDER BY acq_s) AS next_s FROM (SELECT DISTINCT user_id, acq_s FROM detections) d) w WHERE next_s IS NULL OR next_s - acq_s > 900")
both("win_02_interval_union", """
WITH s AS (SELECT user_id, acq_s AS from_s, acq_s + 3600 * (1 + event_id % 3) AS to_s, event_id FROM detections),
i AS (SELECT *, CASE WHEN from_s - max(to_s) OVER (PARTITION BY user_id ORDER BY from_s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 60 THEN 0 ELSE 1 END AS opens FROM s),
g AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY user_id ORDER BY from_s, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM i)
SELECT user_id, min(from_s) AS from_s, max(to_s) AS to_s, count(*) AS parts FROM g GROUP BY user_id, island""")
both("win_03_thinned", "WITH r AS (SELECT fire_id, acq_s, row_number() OVER (PARTITION BY fire_id ORDER BY acq_s, uid) - 1 AS i, count(*) OVER (PARTITION BY fire_id) AS n FROM members), k AS (SELECT * FROM (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS t(k)) SELECT DISTINCT fire_id, acq_s, CAST(i AS BIGINT) AS i FROM r JOIN k ON r.n <= 8 OR r.i = CAST(floor(k.k * (r.n - 1) / 7.0) AS BIGINT)")
both("win_05_direction_changes", "WITH m AS (SELECT public_id, at_s, transition_id, CAST(sign(state_rank - lag(state_rank) OVER (PARTITION BY public_id ORDER BY at_s, transition_id)) AS BIGINT) AS direction FROM transitions) SELECT transition_id, direction, coalesce(direction * lag(direction) OVER (PARTITION BY public_id ORDER BY at_s, transition_id) < 0, FALSE) AS turned FROM m WHERE direction <> 0")
both("win_07_trailing_empty_days", f"SELECT user_id, CAST(floor({NOW} / 86400.0) AS BIGINT) - max(CAST(floor(acq_s / 86400.0) AS BIGINT)) - 1 AS empty_days FROM detections WHERE event_id % 4 <> 0 GROUP BY user_id")
both("win_09_budget_cutoff", "SELECT transition_id, seq, CASE WHEN seq <= 20 THEN 'pending' ELSE 'awaiting_approval' END AS verdict FROM (SELECT transition_id, 5 + CAST(row_number() OVER (PARTITION BY public_id ORDER BY state_rank, at_s, transition_id) AS BIGINT) AS seq FROM transitions) r")
_NOTIFYING = "WITH d AS (SELECT z.account_id, z.zone_id, f.fire_id, abs(z.lat_e5 - f.lat_e5) + abs(z.lon_e5 - f.lon_e5) AS far FROM zones z JOIN fires f ON abs(z.lat_e5 - f.lat_e5) + abs(z.lon_e5 - f.lon_e5) < 40000) SELECT account_id, zone_id, fire_id, CASE WHEN row_number() OVER (PARTITION BY account_id, fire_id ORDER BY far, zone_id) = 1 THEN 'send' ELSE 'suppress' END AS outcome FROM d"
# The nearest zone of an account is found for each place of fires; all pairs are then joined with the ids of those that notify.
both("win_10_notifying_zone", f"""
WITH {near_zones(40000, 'account_id, zone_id, leads', 'abs(zy - fy) + abs(zx - fx) < 40000', ', zone_id = min(zone_id) OVER (PARTITION BY account_id, lat_e5, lon_e5) AS leads')}, zn AS (SELECT account_id, lat_e5, lon_e5, min(zone_id) AS zone_id FROM zones GROUP BY account_id, lat_e5, lon_e5),
n AS (SELECT /*+ MERGE(pp, zn) */ fy, fx, zy, zx, zone_id, row_number() OVER (PARTITION BY account_id, fy, fx ORDER BY abs(zy - fy) + abs(zx - fx), zone_id) AS r FROM pp JOIN zn ON zn.lat_e5 = zy AND zn.lon_e5 = zx),
w AS (SELECT fy, fx, zy, zx, collect_list(zone_id) AS firsts FROM n WHERE r = 1 GROUP BY fy, fx, zy, zx), pw AS (SELECT pp.*, w.firsts FROM pp LEFT JOIN w ON w.fy = pp.fy AND w.fx = pp.fx AND w.zy = pp.zy AND w.zx = pp.zx),
fw AS (SELECT /*+ MERGE(f, pw) */ f.fire_id, pw.zy, pw.zx, pw.firsts FROM fires f JOIN pw ON pw.fy = f.lat_e5 AND pw.fx = f.lon_e5)
SELECT /*+ MERGE(f, w) */ z.account_id, z.zone_id, f.fire_id, CASE WHEN z.leads AND array_contains(f.firsts, z.zone_id) THEN 'send' ELSE 'suppress' END AS outcome FROM {NEAR.replace('fc f', 'fw f')}account_id, zone_id, leads""", _NOTIFYING)
both("win_12_change_kinds", "SELECT transition_id, CASE WHEN was IS NULL THEN 'created' WHEN to_status = 'F' AND weight < 5000 THEN 'removed' WHEN was <> to_status THEN 'status_changed' ELSE 'updated' END AS kind FROM (SELECT *, lag(to_status) OVER (PARTITION BY public_id ORDER BY at_s, transition_id) AS was FROM transitions) t")
both("win_13_latest_version", f"SELECT window_s, event_id, published_s FROM (SELECT acq_s - acq_s % 3600 AS window_s, event_id, CASE WHEN event_id % 6 <> 0 THEN available_s END AS published_s, row_number() OVER (PARTITION BY acq_s - acq_s % 3600 ORDER BY CASE WHEN event_id % 6 <> 0 THEN available_s END DESC NULLS LAST, acq_s DESC, event_id DESC) AS r FROM detections WHERE acq_s >= {NOW - 10 * DAY}) v WHERE r = 1")
both("win_15_state_as_of", "WITH t AS (SELECT *, lag(to_status) OVER (PARTITION BY public_id ORDER BY at_s, transition_id) AS from_status FROM transitions) SELECT public_id, coalesce(max_by(to_status, CASE WHEN at_s < 870000000 THEN at_s * 10000000 + transition_id END), min_by(coalesce(from_status, 'none'), CASE WHEN at_s >= 870000000 THEN at_s * 10000000 + transition_id END)) AS status FROM t GROUP BY public_id")
both("win_16_next_event", "SELECT t.transition_id, min(n.at_s) AS next_s FROM transitions t LEFT JOIN transitions n ON n.public_id = t.public_id AND n.at_s > t.at_s WHERE t.to_status = 'F' GROUP BY t.transition_id")
both("win_17_occurrence", "SELECT transition_id, concat(CAST(public_id AS VARCHAR(20)), '#', CAST(row_number() OVER (PARTITION BY public_id ORDER BY at_s, transition_id) AS VARCHAR(20))) AS name FROM transitions WHERE to_status = 'F'")
both("win_20_new_signals", "WITH seen AS (SELECT fire_id, last_s - 7200 * (fire_id % 2) AS seen_s FROM fires WHERE fire_id % 5 <> 0) SELECT f.fire_id, f.last_s, s.fire_id IS NULL AS is_new FROM fires f LEFT JOIN seen s ON s.fire_id = f.fire_id WHERE s.fire_id IS NULL OR f.last_s > s.seen_s")
both("win_21_newest_kept", f"SELECT user_id, fire_id, last_s FROM (SELECT CAST(floor(fire_id / 1000.0) AS BIGINT) AS user_id, fire_id, last_s, row_number() OVER (PARTITION BY CAST(floor(fire_id / 1000.0) AS BIGINT) ORDER BY last_s DESC, fire_id) AS r FROM fires WHERE last_s >= {NOW - 25 * DAY}) r WHERE r <= 5")
both("win_22_ranked", "SELECT name, size_rank FROM (SELECT p_name AS name, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS size_rank FROM {part}) r WHERE size_rank <= 3".replace("SELECT name, size_rank FROM", "SELECT name, p_type, CAST(size_rank AS BIGINT) AS size_rank FROM"))

# --- state rules
both("str_04_survivor_by_key", "SELECT user_key, min_by(fire_id, started_s * 1000 - n) AS survivor FROM (SELECT CAST(floor(fire_id / 1000.0) AS BIGINT) AS user_key, * FROM fires) f GROUP BY user_key")
both("str_08_pass_verdicts", f"""
WITH passes AS (SELECT event_id, source, acq_s, event_id % 101 AS cloud, event_id % 19 = 0 AS frozen FROM detections WHERE acq_s >= {NOW - 15 * DAY})
SELECT event_id, CASE WHEN acq_s <= {NOW - 12 * DAY} THEN 'detected' WHEN frozen THEN 'source_frozen' WHEN cloud IS NULL OR cloud > 80 THEN 'cloud_blocked' WHEN cloud >= 50 THEN 'half_weight' ELSE 'counted' END AS verdict,
       CASE WHEN acq_s <= {NOW - 12 * DAY} OR frozen OR cloud > 80 THEN 0 WHEN cloud >= 50 THEN 50 ELSE 100 END AS weight_pct FROM passes""")
both("str_09_frozen", "WITH outages AS (SELECT * FROM (VALUES ('modis', 1704500000, 1704900000), ('viirs_snpp', 1705500000, CAST(NULL AS BIGINT))) AS t(source, from_s, to_s)) SELECT d.event_id, coalesce(bool_or(o.source IS NOT NULL), FALSE) AS frozen FROM detections d LEFT JOIN outages o ON o.source = d.source AND d.acq_s >= o.from_s AND (o.to_s IS NULL OR d.acq_s < o.to_s) GROUP BY d.event_id")
both("str_10_cloud_band", "WITH hours AS (SELECT DISTINCT acq_s - acq_s % 3600 AS hour_s, CAST(floor(acq_s / 3600.0) AS BIGINT) * 37 % 101 AS cloud FROM detections WHERE event_id % 3 <> 0) SELECT d.event_id, CASE WHEN h.cloud IS NULL OR h.cloud > 80 THEN 'blocked' WHEN h.cloud >= 50 THEN 'half' ELSE 'clear' END AS band FROM detections d LEFT JOIN hours h ON h.hour_s = d.acq_s - d.acq_s % 3600")
both("str_11_lifecycle", f"""
WITH e AS (SELECT fire_id, status, {NOW} - last_s AS idle_s, fire_id % 60 AS e_tenths, n * 14 >= 100 OR max_frp >= 100 AS large, fire_id % 2 = 0 AS both_phases, fire_id % 20 AS blind_days FROM fires)
SELECT fire_id, CASE WHEN status = 'officially_extinguished' THEN status WHEN idle_s <= {3 * DAY} AND fire_id % 3 = 0 THEN 'active'
  WHEN e_tenths >= CASE WHEN large THEN 50 ELSE 30 END AND idle_s >= {DAY} AND both_phases THEN 'no_longer_detected'
  WHEN blind_days >= 14 AND idle_s >= {14 * DAY} THEN 'no_longer_detected' WHEN e_tenths * 2 >= CASE WHEN large THEN 50 ELSE 30 END THEN 'signal_weakening' ELSE 'active' END AS next_status FROM e""")
both("str_12_display_tier", f"SELECT fire_id, CASE WHEN status NOT IN ('no_longer_detected', 'officially_extinguished') OR {NOW} - last_s < {2 * DAY} THEN 'map' WHEN {NOW} - last_s < {7 * DAY} THEN 'feed' ELSE 'archive' END AS display_tier FROM fires")
both("str_13_large", "SELECT fire_id, n * 14 >= 100 OR coalesce(max_frp >= 100, FALSE) OR fire_id % 29 = 0 AS large FROM fires")
_DECISION = f"""
WITH x AS (SELECT z.zone_id, z.min_score, f.fire_id, f.score, f.n, f.invalidated, f.last_s, f.fire_id % 23 = 0 AS quarantined, (z.zone_id + f.fire_id) % 5 AS known, {NOW - 10 * DAY} - (z.zone_id * f.fire_id % 40000) AS notified_s, {NOW - 10 * DAY} AS at_s
  FROM zones z JOIN fires f ON abs(z.lat_e5 - f.lat_e5) < 15000 AND abs(z.lon_e5 - f.lon_e5) < 20000)
SELECT zone_id, fire_id, CASE WHEN quarantined THEN 'suppress:quarantined' WHEN invalidated THEN 'suppress:invalidated' WHEN n < 2 THEN 'suppress:insufficient_persistence' WHEN score < min_score THEN 'suppress:below_zone_threshold'
  WHEN known = 4 THEN 'suppress:pre_existing' WHEN known > 0 AND at_s - notified_s < 1800 THEN 'defer:digest_floor' WHEN known > 0 AND at_s - notified_s < 21600 THEN 'defer:suppression_window'
  WHEN known = 0 AND at_s - last_s > 1800 THEN 'defer:stale_trigger' WHEN (at_s + 7200) % 86400 NOT BETWEEN 25200 AND 79199 AND min_score < 0.45 THEN 'defer:quiet_hours' ELSE 'send' END AS decision FROM x"""
_MEET = "zones z JOIN fires f ON abs(z.lat_e5 - f.lat_e5) < 15000 AND abs(z.lon_e5 - f.lon_e5) < 20000"
both("str_15_alert_decision", _DECISION.replace("WITH x AS", f"WITH {near_zones(20000, 'zone_id, min_score', 'abs(zy - fy) < 15000 AND abs(zx - fx) < 20000')}, x AS").replace(_MEET, NEAR + "zone_id, min_score").replace("(SELECT z.", "(SELECT /*+ MERGE(f, w) */ z."), _DECISION)
both("str_16_escalation_step", "SELECT f.fire_id, greatest(CASE WHEN f.score >= 0.75 AND f.score - 0.3 < 0.75 THEN 1 ELSE 0 END, CASE WHEN f.n * 14 >= 2 * greatest(10, f.n * 5) THEN 2 ELSE 0 END, CASE WHEN f.status = 'active' AND f.max_frp > 400 THEN 3 ELSE 0 END) AS step FROM fires f")
_BREAKER = f"WITH s AS (SELECT at_s, transition_id, count(*) OVER (ORDER BY at_s RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS recent FROM transitions) SELECT transition_id, recent, CASE WHEN recent > greatest(5 * 6, 20) THEN 'latched' ELSE 'open' END AS breaker FROM s"
# A row enters the window at its time and leaves it a day later: sums by day, and running sums within a day, need no task that sees all.
both("str_21_dispatch_breaker", f"""
WITH e AS (SELECT at_s AS s, transition_id, 1 AS v FROM transitions UNION ALL SELECT at_s + {DAY} + 1 AS s, NULL AS transition_id, -1 AS v FROM transitions),
r AS (SELECT s - s % {DAY} AS day_s, transition_id, sum(v) OVER (PARTITION BY s - s % {DAY} ORDER BY s RANGE UNBOUNDED PRECEDING) AS own FROM e),
t AS (SELECT s - s % {DAY} AS day_s, sum(v) AS v FROM e GROUP BY 1), k AS (SELECT day_s, sum(v) OVER (ORDER BY day_s) - v AS carried FROM t)
SELECT r.transition_id, r.own + k.carried AS recent, CASE WHEN r.own + k.carried > 30 THEN 'latched' ELSE 'open' END AS breaker FROM r JOIN k ON k.day_s = r.day_s WHERE r.transition_id IS NOT NULL""", _BREAKER)
both("str_29_streaks", """
WITH r AS (SELECT source, acq_s, event_id, CASE WHEN frp > 300 THEN 1 WHEN frp < 250 THEN -1 ELSE 0 END AS mark FROM detections),
g AS (SELECT *, CAST(sum(changed) OVER (PARTITION BY source ORDER BY acq_s, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM (SELECT *, CASE WHEN mark = lag(mark) OVER (PARTITION BY source ORDER BY acq_s, event_id) THEN 0 ELSE 1 END AS changed FROM r) c),
s AS (SELECT *, row_number() OVER (PARTITION BY source, run ORDER BY acq_s, event_id) AS streak FROM g)
SELECT event_id, CAST(streak AS BIGINT) AS streak, CASE WHEN mark = 1 AND streak = 3 THEN 'page' WHEN mark = -1 AND streak = 5 THEN 'resolve' ELSE 'hold' END AS step FROM s""")
both("str_30_staleness", f"WITH a AS (SELECT * FROM (VALUES ('viirs_snpp', 1), ('slstr', 1), ('landsat', 0)) AS t(source, attempted)), l AS (SELECT source, max(acq_s) AS ok_s FROM detections GROUP BY source) SELECT a.source, CASE WHEN a.attempted = 0 THEN 'unknown' WHEN l.ok_s IS NULL THEN 'critical' WHEN {NOW} - l.ok_s > {3 * DAY} THEN 'warn' ELSE 'ok' END AS status FROM a LEFT JOIN l ON l.source = a.source")
both("str_36_recompute_reason", "WITH c AS (SELECT fire_id, lat_e5 + fire_id % 3 * 900 AS lat_e5, last_s - fire_id % 4 * 50 AS last_s, CASE fire_id % 7 WHEN 0 THEN 'v1' ELSE 'v2' END AS version FROM fires WHERE fire_id % 11 <> 0) SELECT f.fire_id, CASE WHEN c.fire_id IS NULL THEN 'missing' WHEN c.version <> 'v2' THEN 'params' WHEN abs(c.lat_e5 - f.lat_e5) > 900 THEN 'moved' WHEN abs(c.last_s - f.last_s) > 60 THEN 'redated' END AS reason FROM fires f LEFT JOIN c ON c.fire_id = f.fire_id")
both("str_40_snapshot_merge", "WITH held AS (SELECT fire_id, seq, 'held' AS v FROM fires WHERE fire_id % 3 <> 0), snap AS (SELECT fire_id, seq + fire_id % 3 - 1 AS seq, 'snap' AS v FROM fires WHERE fire_id % 4 <> 0) SELECT fire_id, max(seq) AS seq, max_by(v, seq * 2 + CASE v WHEN 'held' THEN 1 ELSE 0 END) AS v FROM (SELECT * FROM held UNION ALL SELECT * FROM snap) u GROUP BY fire_id")
both("str_42_expired_tombstones", f"SELECT fire_id FROM fires WHERE merged_into IS NOT NULL AND {NOW} - last_s < {20 * DAY}")
