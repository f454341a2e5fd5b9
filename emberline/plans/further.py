"""Further statements of the inventory: work lists, keyed writes, ordered analytics, histograms and verdicts, for both engines."""

from __future__ import annotations

from emberline.plans.catalog import NEAR, both, near_zones
from emberline.plans.analytics import RANKED_LAGS
from emberline.plans.relational import DAY, NOW

# --- reading
both("src_14_slot_floor", "SELECT event_id, (available_s - 1200) - (available_s - 1200) % 900 AS slot_s FROM detections")
both("src_24_page_title", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM {pages}")
both("flt_05_archive_projection", "SELECT uid, tier, source, acq_s, available_s, lat_e5, lon_e5, confidence, day_night, 'v2' AS collection_version, coalesce(quarantined, FALSE) AS quarantined FROM detections")
both("flt_10_staleness_gate", f"WITH doc AS (SELECT max(available_s) AS at_s FROM detections WHERE source = 'modis') SELECT d.event_id, d.acq_s FROM detections d CROSS JOIN doc WHERE d.source = 'modis' AND {NOW} - doc.at_s <= {3 * DAY}")

# --- joins
both("jn_25_final_survivor", """
WITH RECURSIVE chain(alias, survivor, depth) AS (SELECT alias, alias, 0 FROM aliases WHERE alias % 30 = 11 UNION ALL SELECT c.alias, a.merged_into, c.depth + 1 FROM chain c JOIN aliases a ON a.alias = c.survivor WHERE a.merged_into IS NOT NULL AND c.depth < 16)
SELECT alias, max_by(survivor, depth) AS survivor, max(depth) AS depth FROM chain GROUP BY alias""")
both("jn_31_structural_diff", """
WITH expected AS (SELECT fire_id, status FROM fires WHERE fire_id % 11 <> 0), actual AS (SELECT fire_id, CASE WHEN fire_id % 29 = 0 THEN 'active' ELSE status END AS status FROM fires WHERE fire_id % 13 <> 0)
SELECT 'missing' AS side, fire_id, status FROM (SELECT * FROM expected EXCEPT ALL SELECT * FROM actual) a UNION ALL SELECT 'unexpected' AS side, fire_id, status FROM (SELECT * FROM actual EXCEPT ALL SELECT * FROM expected) b""")
both("jn_43_config_over_default", "WITH base AS (SELECT r_regionkey AS k, r_regionkey * 10 AS v FROM {region}), own AS (SELECT r_regionkey AS k, CASE WHEN r_regionkey % 2 = 0 THEN r_regionkey * 11 END AS v FROM {region} WHERE r_regionkey < 4) SELECT b.k, coalesce(o.v, b.v) AS v FROM base b LEFT JOIN own o ON o.k = b.k")

# --- aggregates
_LAG_DAYS = "CASE WHEN lag_s < 0 THEN -1 WHEN lag_s < 604800 THEN 0 WHEN lag_s < 2592000 THEN 1 WHEN lag_s < 5184000 THEN 2 WHEN lag_s < 10368000 THEN 3 ELSE 4 END"
both("agg_19_histogram_by_source", f"SELECT source, {_LAG_DAYS} AS bucket, count(*) AS n, min(lag_s) AS least_s, max(lag_s) AS most_s, CAST(sum(lag_s) AS BIGINT) AS total_s FROM lags GROUP BY 1, 2")
both("agg_21_merged_histogram", f"""
WITH daily AS (SELECT source, available_s - available_s % {DAY} AS day_s, {_LAG_DAYS} AS bucket, count(*) AS n, min(lag_s) AS least_s, max(lag_s) AS most_s FROM lags GROUP BY 1, 2, 3)
SELECT source, bucket, CAST(sum(n) AS BIGINT) AS n, min(least_s) AS least_s, max(most_s) AS most_s, count(*) AS days FROM daily GROUP BY source, bucket""")
_PROFILE = """
WITH r AS (SELECT source, lag_s, row_number() OVER (PARTITION BY source ORDER BY lag_s) AS k, count(*) OVER (PARTITION BY source) AS n FROM lags)
SELECT source, max(n) AS n, min(CASE WHEN k * 100 >= n * 50 THEN lag_s END) AS p50, min(CASE WHEN k * 100 >= n * 90 THEN lag_s END) AS p90, min(CASE WHEN k * 100 >= n * 99 THEN lag_s END) AS p99 FROM r GROUP BY source"""
# Lags are counted before they are ranked: k is the last row of each, so the first lag that reaches a rank is the same.
both("agg_23_availability_profile", _PROFILE.replace("WITH r AS (SELECT source, lag_s, row_number() OVER (PARTITION BY source ORDER BY lag_s) AS k, count(*) OVER (PARTITION BY source) AS n FROM lags)", RANKED_LAGS.replace("AS r,", "AS k,")), _PROFILE)
both("agg_25_merged_shards", "WITH shard AS (SELECT event_id % 8 AS shard, source, count(*) AS n, max(acq_s) AS last_s FROM detections GROUP BY 1, 2) SELECT source, CAST(sum(n) AS BIGINT) AS n, max(last_s) AS last_s, count(*) AS shards FROM shard GROUP BY source")
both("agg_36_pooled_tallies", """
WITH c AS (SELECT fire_id % 4 AS season, user_id, fire_id, count(*) AS n FROM members GROUP BY 1, 2, 3), s AS (SELECT season, CAST(sum(n * (n - 1)) AS BIGINT) AS pairs2, count(*) AS events FROM c GROUP BY season)
SELECT CAST(sum(pairs2) AS BIGINT) AS pairs2, CAST(sum(events) AS BIGINT) AS events, count(*) AS seasons FROM s""")
both("agg_37_derived_metrics", """
WITH c AS (SELECT user_id, fire_id, count(*) AS n FROM members GROUP BY user_id, fire_id), u AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * (n - 1)) AS BIGINT) AS hit FROM c GROUP BY user_id)
SELECT user_id, n, hit, CASE WHEN n > 1 THEN CAST(floor(1000000.0 * hit / (n * (n - 1)) + 0.5) AS BIGINT) END AS recall_e6 FROM u""")
both("agg_46_queue_ages", f"SELECT o_orderstatus AS status, count(*) AS n, {NOW} - min({{epoch(o_orderdate)}}) AS oldest_s FROM {{orders}} GROUP BY o_orderstatus")

# --- ordered analytics
both("win_06_reversal_bursts", "SELECT public_id, at_s FROM (SELECT public_id, at_s, lag(at_s, 2) OVER (PARTITION BY public_id ORDER BY at_s, transition_id) AS second_before_s FROM transitions) t WHERE at_s - second_before_s <= 15552000")
# Of an account's zones at one place the smallest id stands for all, and what is nearest to a place of fires is so for all fires there.
both("win_11_nearest_entries", f"""
WITH {near_zones(40000)}, zn AS (SELECT account_id, lat_e5, lon_e5, min(zone_id) AS zone_id FROM zones GROUP BY account_id, lat_e5, lon_e5),
n AS (SELECT /*+ MERGE(pp, zn) */ account_id, fy, fx, zone_id, row_number() OVER (PARTITION BY account_id, fy, fx ORDER BY abs(zy - fy) + abs(zx - fx), zone_id) AS r FROM pp JOIN zn ON zn.lat_e5 = zy AND zn.lon_e5 = zx WHERE abs(zy - fy) + abs(zx - fx) < 40000)
SELECT /*+ MERGE(f, n) */ n.account_id, f.fire_id, n.zone_id FROM fires f JOIN n ON n.fy = f.lat_e5 AND n.fx = f.lon_e5 WHERE n.r = 1 AND f.tier = 'map'""", "SELECT account_id, fire_id, zone_id FROM (SELECT z.account_id, f.fire_id, z.zone_id, row_number() OVER (PARTITION BY z.account_id, f.fire_id ORDER BY abs(z.lat_e5 - f.lat_e5) + abs(z.lon_e5 - f.lon_e5), z.zone_id) AS r FROM zones z JOIN fires f ON abs(z.lat_e5 - f.lat_e5) + abs(z.lon_e5 - f.lon_e5) < 40000 AND f.tier = 'map') x WHERE r = 1")
both("win_14_newest_version", "SELECT source, window_s, event_id FROM (SELECT source, acq_s - acq_s % 10800 AS window_s, event_id, row_number() OVER (PARTITION BY source, acq_s - acq_s % 10800 ORDER BY CASE WHEN event_id % 3 <> 0 THEN available_s END DESC NULLS LAST, available_s DESC, uid DESC) AS r FROM detections) x WHERE r = 1")
both("win_18_merge_plan", """
WITH links AS (SELECT merged_into AS survivor, fire_id AS gone, seq FROM fires WHERE merged_into IS NOT NULL)
SELECT l.survivor, l.gone, row_number() OVER (PARTITION BY l.survivor ORDER BY l.gone) AS nth, greatest(l.seq, coalesce(f.seq, 0)) AS last_seq, f.fire_id IS NULL AS dangling FROM links l LEFT JOIN fires f ON f.fire_id = l.survivor""")
both("win_19_first_wins_counters", f"""
WITH r AS (SELECT source, acq_s BETWEEN {NOW - 30 * DAY} AND {NOW - 8 * DAY} AS in_window, lat BETWEEN 41.2 AND 43.5 AS in_box, row_number() OVER (PARTITION BY source, user_id, acq_s ORDER BY event_id) AS copy FROM detections)
SELECT source, count(*) FILTER (WHERE NOT in_window) AS outside_window, count(*) FILTER (WHERE in_window AND NOT in_box) AS outside_box, count(*) FILTER (WHERE in_window AND in_box AND copy > 1) AS repeated, count(*) FILTER (WHERE in_window AND in_box AND copy = 1) AS kept FROM r GROUP BY source""")

# --- sorts
both("srt_03_member_order", "SELECT fire_id, uid, row_number() OVER (PARTITION BY fire_id ORDER BY acq_s, uid) AS nth FROM members")
both("srt_11_drifted_contexts", "WITH drawn AS (SELECT fire_id, lat_e5 + (fire_id % 5) * 300 AS lat_e5, started_s + (fire_id % 7) * 20 AS started_s FROM fires WHERE fire_id % 9 <> 0) SELECT f.fire_id FROM fires f LEFT JOIN drawn d ON d.fire_id = f.fire_id WHERE d.fire_id IS NULL OR abs(d.lat_e5 - f.lat_e5) > 900 OR abs(d.started_s - f.started_s) > 60 ORDER BY f.last_s DESC, f.fire_id LIMIT 40")
both("srt_13_history_columns", f"""
WITH w AS (SELECT uid, acq_s, source, lat_e5, lon_e5 FROM detections WHERE acq_s >= {NOW - 12 * DAY}), newest AS (SELECT * FROM w ORDER BY acq_s DESC, uid LIMIT 10000), total AS (SELECT count(*) AS n FROM w)
SELECT n.uid, dense_rank() OVER (ORDER BY n.source) - 1 AS source_code, CAST(floor(n.acq_s / 60.0) AS BIGINT) AS minute, CAST(floor(n.lat_e5 / 100.0 + 0.5) AS BIGINT) AS lat_e3, CAST(floor(n.lon_e5 / 100.0 + 0.5) AS BIGINT) AS lon_e3, t.n > 10000 AS truncated FROM newest n CROSS JOIN total t""")
both("srt_14_name_search", """
SELECT p_partkey, p_name, CASE WHEN lower(p_name) = 'part 12' THEN 0 WHEN lower(p_name) LIKE 'part%' THEN 1 WHEN lower(p_name) LIKE '% 1%' THEN 2 ELSE 3 END AS score FROM {part} WHERE lower(p_name) LIKE '%1%'
ORDER BY CASE WHEN lower(p_name) = 'part 12' THEN 0 WHEN lower(p_name) LIKE 'part%' THEN 1 WHEN lower(p_name) LIKE '% 1%' THEN 2 ELSE 3 END, length(p_name), p_name, p_partkey LIMIT 20""")
both("srt_17_diff_lines", """
WITH live AS (SELECT fire_id, status, n FROM fires WHERE fire_id % 10 <> 3), shadow AS (SELECT fire_id, CASE WHEN fire_id % 17 = 1 THEN 'active' ELSE status END AS status, n + CASE WHEN fire_id % 19 = 2 THEN 1 ELSE 0 END AS n FROM fires WHERE fire_id % 10 <> 4)
SELECT coalesce(l.fire_id, s.fire_id) AS fire_id, CASE WHEN s.fire_id IS NULL THEN 'event_missing' WHEN l.fire_id IS NULL THEN 'event_extra' WHEN l.status <> s.status THEN 'status' ELSE 'members' END AS kind
FROM live l FULL OUTER JOIN shadow s ON s.fire_id = l.fire_id WHERE l.fire_id IS NULL OR s.fire_id IS NULL OR l.status <> s.status OR l.n <> s.n ORDER BY fire_id, kind""")

# --- sets
both("set_02_recursive_union", "WITH RECURSIVE d(day, s) AS (SELECT 0, 1704067200 UNION ALL SELECT day + 1, s + 86400 FROM d WHERE day < 40) SELECT d.day, count(x.event_id) AS n FROM d LEFT JOIN (SELECT event_id, acq_s - acq_s % 86400 AS s FROM detections) x ON x.s = d.s GROUP BY d.day")
both("set_03_matched_and_missing", """
WITH theirs AS (SELECT uid FROM detections WHERE event_id % 10 <> 1), own AS (SELECT uid FROM detections WHERE event_id % 13 <> 2)
SELECT 'matched' AS side, uid FROM (SELECT uid FROM theirs INTERSECT SELECT uid FROM own) a UNION ALL SELECT 'missing' AS side, uid FROM (SELECT uid FROM theirs EXCEPT SELECT uid FROM own) b UNION ALL SELECT 'extra' AS side, uid FROM (SELECT uid FROM own EXCEPT SELECT uid FROM theirs) c""")

# --- keyed writes
both("snk_06_outline_upsert", "WITH held AS (SELECT fire_id, 'old' AS ring FROM fires WHERE fire_id % 2 = 0), incoming AS (SELECT fire_id, concat('POINT(', CAST(lon_e5 AS VARCHAR(12)), ' ', CAST(lat_e5 AS VARCHAR(12)), ')') AS ring FROM fires WHERE fire_id % 3 = 0) SELECT coalesce(i.fire_id, h.fire_id) AS fire_id, coalesce(i.ring, h.ring) AS ring FROM held h FULL OUTER JOIN incoming i ON i.fire_id = h.fire_id")
both("add_07_relation_links", "WITH links AS (SELECT c.fire_id AS child, c.fire_id - 1 AS parent FROM fires c WHERE c.fire_id % 8 = 5) SELECT f.fire_id, p.fire_id AS related, CASE WHEN p.fire_id IS NOT NULL THEN 'reignition' END AS kind FROM fires f LEFT JOIN links l ON l.child = f.fire_id LEFT JOIN fires p ON p.fire_id = l.parent")
both("add_08_refreshed_clusters", "WITH a AS (SELECT fire_id, count(*) AS n, min(lat_e5) AS south, max(lat_e5) AS north, min(lon_e5) AS west, max(lon_e5) AS east FROM members WHERE NOT quarantined GROUP BY fire_id) SELECT f.fire_id, coalesce(a.n, f.n) AS n, a.south, a.north, a.west, a.east FROM fires f LEFT JOIN a ON a.fire_id = f.fire_id")
both("add_09_verdict_update", "WITH v AS (SELECT fire_id, CASE WHEN bool_and(over_water) THEN 'static_source' WHEN bool_or(over_water) THEN 'annotated' ELSE 'clear' END AS verdict FROM members GROUP BY fire_id) SELECT f.fire_id, CAST(floor(CASE WHEN v.verdict = 'static_source' THEN 0 ELSE f.score * 100 END + 0.5) AS BIGINT) AS score_e2, v.verdict FROM fires f JOIN v ON v.fire_id = f.fire_id")
both("add_10_carry_update", "WITH c AS (SELECT public_id, max(at_s) AS until_s, count(*) AS misses FROM transitions GROUP BY public_id) SELECT k.c_custkey AS public_id, coalesce(c.until_s, 0) AS until_s, coalesce(c.misses, 0) AS misses FROM {customer} k LEFT JOIN c ON c.public_id = k.c_custkey")
both("add_11_seeded_events", "WITH held AS (SELECT fire_id FROM fires WHERE fire_id % 5 <> 0) SELECT f.fire_id, concat('POINT(', CAST(f.lon_e5 AS VARCHAR(12)), ' ', CAST(f.lat_e5 AS VARCHAR(12)), ')') AS place FROM fires f WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.fire_id = f.fire_id)")
# SQL leaves open which of equal seqs the page ends with; here it is always the lowest fire_id, however the rows lie in partitions.
_AFTER_CURSOR = "WITH c AS (SELECT fire_id, count(*) AS members, count(*) FILTER (WHERE confidence = 'high') AS high FROM members GROUP BY fire_id), page AS (SELECT fire_id, seq FROM fires WHERE seq > 15000 ORDER BY seq LIMIT 50) SELECT p.fire_id, p.seq, c.members, c.high FROM page p JOIN c ON c.fire_id = p.fire_id"
both("add_13_events_after_cursor", _AFTER_CURSOR.replace("ORDER BY seq LIMIT", "ORDER BY seq, fire_id LIMIT"), plain=_AFTER_CURSOR)
both("add_15_cursor", "SELECT greatest(max(seq), 15000) AS cursor FROM (SELECT seq FROM fires WHERE seq > 15000 ORDER BY seq LIMIT 50) p")
both("add_17_window_log", f"WITH log AS (SELECT account_id, created_s - created_s % {DAY} AS window_s FROM zones WHERE zone_id % 4 = 0), incoming AS (SELECT account_id, created_s - created_s % {DAY} AS window_s, count(*) AS entries FROM zones GROUP BY 1, 2) SELECT i.account_id, i.window_s, i.entries FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.account_id = i.account_id AND l.window_s = i.window_s)")
both("add_18_status_and_seq", "WITH mark AS (SELECT max(seq) AS mark FROM fires), moved AS (SELECT fire_id, fire_id AS nth FROM fires WHERE status = 'active' AND n < 3 AND merged_into IS NULL) SELECT f.fire_id, CASE WHEN m.fire_id IS NOT NULL THEN 'signal_weakening' ELSE f.status END AS status, CASE WHEN m.fire_id IS NOT NULL THEN k.mark + m.nth ELSE f.seq END AS seq FROM fires f CROSS JOIN mark k LEFT JOIN moved m ON m.fire_id = f.fire_id")
both("add_23_alert_append", "WITH held AS (SELECT public_id, to_status FROM transitions WHERE transition_id % 2 = 0), incoming AS (SELECT public_id, to_status, min(at_s) AS at_s FROM transitions GROUP BY public_id, to_status) SELECT i.* FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.public_id = i.public_id AND h.to_status = i.to_status)")
both("add_24_streak_state", """
WITH t AS (SELECT public_id, at_s, transition_id, CASE WHEN state_rank = 0 THEN 1 ELSE 0 END AS ok FROM transitions), g AS (SELECT *, sum(ok) OVER (PARTITION BY public_id ORDER BY at_s, transition_id ROWS UNBOUNDED PRECEDING) AS resets FROM t),
s AS (SELECT public_id, max(resets) AS last_run FROM g GROUP BY public_id) SELECT s.public_id, count(CASE WHEN g.resets = s.last_run AND g.ok = 0 THEN 1 END) AS breaches FROM s JOIN g ON g.public_id = s.public_id GROUP BY s.public_id""")
both("add_30_recent_issues", f"SELECT o.o_orderkey, c.c_custkey FROM {{orders}} o LEFT JOIN {{customer}} c ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0 WHERE (o.o_orderpriority = '1-URGENT' OR c.c_nationkey = 7) AND {{epoch(o.o_orderdate)}} >= {NOW - 3000 * DAY} ORDER BY o.o_orderdate DESC, o.o_orderkey")
both("add_33_retention_plan", f"WITH targets AS (SELECT r_regionkey AS target, CASE r_regionkey WHEN 0 THEN 30 WHEN 1 THEN 90 WHEN 2 THEN 365 WHEN 3 THEN 7 END AS days FROM {{region}}) SELECT target, {NOW} - days * {DAY} AS cutoff_s, days IS NOT NULL AS armed, coalesce(days < 14, FALSE) AS below_floor FROM targets")
both("add_35_constellation_verdict", "WITH checks AS (SELECT fire_id % 6 AS split, score >= 0.05 AS ok FROM fires WHERE fire_id % 6 <> 5) SELECT r.r_regionkey AS split, count(c.ok) AS checks, CASE WHEN count(c.ok) = 0 THEN 'no_data' WHEN bool_and(c.ok) THEN 'pass' ELSE 'fail' END AS verdict FROM {region} r LEFT JOIN checks c ON c.split = r.r_regionkey + 1 GROUP BY r.r_regionkey")
both("add_36_threshold_table", "WITH m AS (SELECT CAST(floor(1000.0 * count(*) FILTER (WHERE confidence = 'high') / count(*) + 0.5) AS BIGINT) AS high_e3, CAST(floor(1000.0 * count(*) FILTER (WHERE day_night = 'N') / count(*) + 0.5) AS BIGINT) AS night_e3 FROM detections) SELECT 'high' AS metric, high_e3 AS v, 400 AS target, high_e3 >= 400 AS met FROM m UNION ALL SELECT 'night' AS metric, night_e3 AS v, 600 AS target, night_e3 >= 600 AS met FROM m")
both("add_43_guarded_ratio", "SELECT source, CASE WHEN count(*) FILTER (WHERE confidence = 'low') * 10 > count(*) * 9 THEN NULL ELSE CAST(floor(1000000.0 * count(*) FILTER (WHERE confidence = 'high') / nullif(count(*) FILTER (WHERE confidence <> 'low'), 0) + 0.5) AS BIGINT) END AS hit_e6 FROM detections GROUP BY source")
both("add_44_gazetteer", "WITH names AS (SELECT ps.s_nationkey AS k, min(ps.s_name) AS alternate FROM {supplier} ps GROUP BY ps.s_nationkey), places AS (SELECT n.n_nationkey, n.n_name, r.r_name, names.alternate, row_number() OVER (PARTITION BY n.n_name ORDER BY n.n_nationkey) AS copy FROM {nation} n JOIN {region} r ON r.r_regionkey = n.n_regionkey LEFT JOIN names ON names.k = n.n_nationkey) SELECT n_nationkey, n_name, r_name, alternate, row_number() OVER (PARTITION BY r_name ORDER BY n_name, n_nationkey) AS place FROM places WHERE copy = 1")
both("add_47_worst_of_account", "WITH parts AS (SELECT account_id, max(CASE WHEN zone_id % 7 = 0 THEN 2 WHEN zone_id % 3 = 0 THEN 1 ELSE 0 END) AS worst, bool_or(zone_id % 11 = 0) AS backup_up FROM zones GROUP BY account_id) SELECT account_id, CASE WHEN worst = 2 AND backup_up THEN 'degraded' WHEN worst = 2 THEN 'outage' WHEN worst = 1 THEN 'degraded' ELSE 'operational' END AS level FROM parts")

# --- verdicts and state
both("str_04_survivor_order", "SELECT user_id, fire_id FROM (SELECT m.user_id, f.fire_id, row_number() OVER (PARTITION BY m.user_id ORDER BY f.started_s, f.n DESC, f.fire_id) AS r FROM fires f JOIN (SELECT DISTINCT user_id, fire_id FROM members) m ON m.fire_id = f.fire_id) x WHERE r = 1")
both("str_19_entries_by_zone", "SELECT account_id, count(*) AS entries, min(zone_id) AS first_zone, max(created_s) AS last_s FROM zones WHERE zone_id % 2 = 0 GROUP BY account_id")
both("str_20_dispatch_verdict", f"SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 4 = 0 THEN 'unapproved' WHEN {{epoch(o_orderdate)}} < {NOW - 9000 * DAY} THEN 'expired' ELSE 'ok' END AS verdict FROM {{orders}}")
both("str_22_lease_cutoff", f"SELECT o_orderkey FROM {{orders}} WHERE o_orderstatus = 'P' AND {{epoch(o_orderdate)}} < {NOW} - 300")
# Fires of one place that reach the same thresholds (top: the highest) have the same nearest zones, found once for all of them.
both("str_23_account_decisions", f"""
WITH {near_zones(40000, 'account_id, zone_id, min_score, leads', 'abs(zy - fy) + abs(zx - fx) < 40000', ', zone_id = min(zone_id) OVER (PARTITION BY account_id, lat_e5, lon_e5, min_score) AS leads')}, ts AS (SELECT s.score, max(m.min_score) AS top FROM (SELECT DISTINCT score FROM fires) s JOIN (SELECT DISTINCT min_score FROM zones) m ON m.min_score <= s.score GROUP BY s.score),
ft AS (SELECT f.fire_id, f.lat_e5, f.lon_e5, ts.top FROM fires f JOIN ts ON ts.score = f.score), k AS (SELECT DISTINCT lat_e5, lon_e5, top FROM ft), zn AS (SELECT account_id, lat_e5, lon_e5, min_score, min(zone_id) AS zone_id FROM zones GROUP BY account_id, lat_e5, lon_e5, min_score),
kp AS (SELECT /*+ MERGE(k, pp) */ pp.*, k.top FROM k JOIN pp ON pp.fy = k.lat_e5 AND pp.fx = k.lon_e5),
n AS (SELECT /*+ MERGE(kp, zn) */ kp.*, zone_id, row_number() OVER (PARTITION BY account_id, fy, fx, top ORDER BY abs(zy - fy), zone_id) AS r FROM kp JOIN zn ON zn.lat_e5 = zy AND zn.lon_e5 = zx AND zn.min_score <= kp.top),
w AS (SELECT fy, fx, zy, zx, top, collect_list(zone_id) AS firsts FROM n WHERE r = 1 GROUP BY fy, fx, zy, zx, top), kw AS (SELECT kp.*, w.firsts FROM kp LEFT JOIN w ON w.fy = kp.fy AND w.fx = kp.fx AND w.zy = kp.zy AND w.zx = kp.zx AND w.top = kp.top),
fw AS (SELECT /*+ MERGE(ft, kw) */ ft.fire_id, kw.top, kw.zy, kw.zx, kw.firsts FROM ft JOIN kw ON kw.fy = ft.lat_e5 AND kw.fx = ft.lon_e5 AND kw.top = ft.top)
SELECT /*+ MERGE(f, w) */ z.account_id, f.fire_id, z.zone_id, CASE WHEN z.leads AND array_contains(f.firsts, z.zone_id) THEN 'send' ELSE 'nearer_zone' END AS outcome FROM {NEAR.replace('fc f', 'fw f')}account_id, zone_id, min_score, leads WHERE z.min_score <= f.top""", "SELECT account_id, fire_id, zone_id, CASE WHEN r = 1 THEN 'send' ELSE 'nearer_zone' END AS outcome FROM (SELECT z.account_id, f.fire_id, z.zone_id, row_number() OVER (PARTITION BY z.account_id, f.fire_id ORDER BY abs(z.lat_e5 - f.lat_e5), z.zone_id) AS r FROM zones z JOIN fires f ON abs(z.lat_e5 - f.lat_e5) + abs(z.lon_e5 - f.lon_e5) < 40000 AND f.score >= z.min_score) x")
both("str_26_frames", "SELECT fire_id, concat('id: ', CAST(seq AS VARCHAR(12)), '|event: ', status, '|data: ', CAST(fire_id AS VARCHAR(20))) AS frame FROM fires")
both("str_32_two_days_overwritten", f"WITH days AS (SELECT source, acq_s - acq_s % {DAY} AS day_s, count(*) AS n FROM detections GROUP BY 1, 2), mark AS (SELECT max(day_s) AS last_s FROM days), held AS (SELECT source, day_s, n - 1 AS n FROM days) SELECT d.source, d.day_s, CASE WHEN d.day_s >= m.last_s - {DAY} THEN d.n ELSE h.n END AS n FROM days d CROSS JOIN mark m JOIN held h ON h.source = d.source AND h.day_s = d.day_s")
both("str_33_late_policy", "SELECT event_id, CASE WHEN acq_s > available_s + 300 THEN 'future' WHEN acq_s < (available_s - 3600) - (available_s - 3600) % 86400 - 86400 THEN 'late' ELSE 'accepted' END AS lane FROM detections")
both("str_35_dirty_keys", "WITH drawn AS (SELECT fire_id, n - CASE WHEN fire_id % 6 = 1 THEN 1 ELSE 0 END AS n FROM fires WHERE fire_id % 10 <> 9), dirty AS (SELECT f.fire_id FROM fires f LEFT JOIN drawn d ON d.fire_id = f.fire_id WHERE d.fire_id IS NULL OR d.n <> f.n) SELECT m.fire_id, count(*) AS members FROM members m WHERE m.fire_id IN (SELECT fire_id FROM dirty) GROUP BY m.fire_id")
both("str_39_mirror_age", f"SELECT source, {NOW} - max(available_s) AS age_s, CASE WHEN {NOW} - max(available_s) > 1000000 THEN 'critical' WHEN {NOW} - max(available_s) > 100000 THEN 'warn' ELSE 'ok' END AS verdict FROM detections GROUP BY source")
both("str_41_seq_upsert", "WITH held AS (SELECT fire_id, seq FROM fires WHERE fire_id % 2 = 0), incoming AS (SELECT fire_id, seq + fire_id % 5 - 2 AS seq, merged_into FROM fires) SELECT i.fire_id, CASE WHEN h.seq IS NOT NULL AND i.seq <= h.seq THEN h.seq ELSE i.seq END AS seq, CASE WHEN h.seq IS NOT NULL AND i.seq <= h.seq THEN 'held' WHEN i.merged_into IS NOT NULL THEN 'tombstone' ELSE 'applied' END AS outcome FROM incoming i LEFT JOIN held h ON h.fire_id = i.fire_id")
both("str_44_arrivals", "SELECT p_partkey AS t, CASE WHEN p_partkey < 60 THEN CAST(floor(p_partkey * p_partkey * 10 / 120.0 + 0.5) AS BIGINT) ELSE 300 + (p_partkey - 60) * 10 END AS arrived FROM {part}")
both("udf_18_staged_month", f"SELECT uid, source, acq_s FROM (SELECT uid, source, acq_s, lat_e5, lon_e5, row_number() OVER (PARTITION BY uid ORDER BY available_s, source) AS copy FROM (SELECT * FROM detections UNION ALL SELECT * FROM detections WHERE event_id % 4 = 0) a WHERE acq_s >= {NOW - 31 * DAY} AND acq_s < {NOW}) b WHERE copy = 1 ORDER BY acq_s, source, uid")
both("udf_21_decision_trace", "SELECT z.zone_id, f.fire_id, f.invalidated AS rule_invalidated, f.score < z.min_score AS rule_below, f.n < 2 AS rule_persistence, CASE WHEN f.invalidated THEN 'invalidated' WHEN f.n < 2 THEN 'insufficient_persistence' WHEN f.score < z.min_score THEN 'below_zone_threshold' ELSE 'send' END AS outcome FROM zones z JOIN fires f ON z.zone_id = f.fire_id % 1500 + 1")
both("udf_23_quota_gate", "SELECT account_id, count(*) AS used, CASE WHEN account_id % 9 = 0 THEN 'latched' WHEN count(*) >= 7 THEN 'over' WHEN count(*) >= 5 THEN 'near' ELSE 'open' END AS gate FROM zones GROUP BY account_id")
both("win_08_daily_cap", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, acq_s - acq_s % 86400 ORDER BY acq_s, uid) * 35 <= 100 THEN 35 ELSE 0 END AS weight_e2 FROM detections")
both("geo_38_prior_lookup", "WITH t AS (SELECT * FROM (VALUES ('low', 25, 40), ('nominal', 65, 80), ('high', 90, 95)) AS t(confidence, day_e2, night_e2)) SELECT d.event_id, CASE WHEN d.day_night = 'N' THEN t.night_e2 ELSE t.day_e2 END AS prior_e2 FROM detections d JOIN t ON t.confidence = d.confidence WHERE d.source LIKE 'viirs%'")
both("fn_36_full_jitter", "SELECT event_id, CAST(floor(CAST(event_id % 101 AS DOUBLE) / 101 * least(1000 * pow(2, event_id % 9), 60000)) AS BIGINT) AS wait_ms FROM detections")
both("fn_41_alias_lookup", "WITH c AS (SELECT alias, merged_into AS target FROM aliases WHERE merged_into IS NOT NULL) SELECT a.alias, coalesce(d.target, c.target, a.alias) AS after_two FROM aliases a LEFT JOIN c ON c.alias = a.alias LEFT JOIN c d ON d.alias = c.target")
both("add_27_cancel_and_mask", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, count(*) FILTER (WHERE o_orderstatus = 'P') AS claimed, count(*) AS rows FROM {orders} WHERE o_custkey % 10 = 4 GROUP BY o_orderpriority")
both("add_31_latest_version", "WITH v AS (SELECT public_id, max_by(transition_id, at_s * 10000000 + transition_id) AS latest FROM transitions GROUP BY public_id) SELECT v.public_id, v.latest, t.to_status FROM v JOIN transitions t ON t.transition_id = v.latest")
both("add_34_zone_seeds", "SELECT z.zone_id, f.fire_id, CASE WHEN f.invalidated THEN 'invalidated' WHEN f.score < z.min_score THEN 'below_zone_threshold' ELSE 'seed' END AS outcome, row_number() OVER (PARTITION BY z.zone_id ORDER BY abs(z.lat_e5 - f.lat_e5) + abs(z.lon_e5 - f.lon_e5), f.fire_id) AS nth FROM zones z JOIN fires f ON z.zone_id = f.fire_id % 1500 + 1")
both("str_25_replay_buffer", "WITH ring AS (SELECT seq, fire_id FROM fires ORDER BY seq DESC, fire_id LIMIT 256), low AS (SELECT min(seq) AS seq FROM ring) SELECT r.seq, r.fire_id, 90000 >= l.seq AS replayable FROM ring r CROSS JOIN low l WHERE r.seq > 90000")
both("str_37_backfill_batch", "SELECT f.fire_id, f.last_s FROM fires f WHERE f.fire_id % 4 = 3 AND NOT EXISTS (SELECT 1 FROM fires d WHERE d.fire_id = f.fire_id AND d.n > 3) ORDER BY f.last_s, f.fire_id LIMIT 25")
