"""Lifecycle ticks over the domain frames: evidence, verdicts, decisions and what a chain of ticks carries on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline import params as p
from emberline.operators import lifecycle, registry
from emberline.operators.graph import pieces, written
from emberline.plans.catalog import frame, query, spark_sql
from emberline.plans.relational import DAY, NOW
from emberline.streaming import digest

HOUR, REGIONS = 3600, 16
FROM = NOW - 20 * DAY
TICKS = [FROM + 5 * DAY, FROM + 10 * DAY, FROM + 15 * DAY, NOW]
#: Nominal passes: source, phase, second of the day.
MODEL = [("viirs_noaa20", "day", 39_900), ("viirs_noaa20", "night", 3_300), ("viirs_snpp", "day", 42_600), ("viirs_snpp", "night", 6_300), ("modis", "day", 36_000), ("modis", "night", 75_600), ("slstr", "night", 73_800)]
OUTAGES = [("modis", FROM + 3 * DAY, FROM + 6 * DAY + 1800), ("geo_msg", FROM + 7 * DAY, FROM + 7 * DAY + 7200), ("viirs_snpp", FROM + 17 * DAY, None)]

#: Events as known before a moment.
_EVENTS = """
SELECT event_id, region, acq_s AS newest_s, frp AS last_frp, max_frp FROM (
  SELECT fire_id AS event_id, user_id % 16 AS region, acq_s, frp, max(frp) OVER (PARTITION BY fire_id) AS max_frp, row_number() OVER (PARTITION BY fire_id ORDER BY acq_s DESC, uid DESC) AS r
  FROM members WHERE acq_s < {at}) m WHERE r = 1"""
_DECLARED = f"SELECT fire_id AS event_id, {FROM} + fire_id % 19 * {DAY} + k * 90000 AS declared_s, CASE WHEN k = 0 THEN 'officially_contained' ELSE 'officially_extinguished' END AS declared_state, 'agency' AS attribution FROM fires JOIN (VALUES (0), (1)) AS t(k) ON fire_id % 31 = 0 AND (k = 0 OR fire_id % 62 = 0)"


def passes(spark: SparkSession) -> DataFrame:
    days = spark.range(REGIONS).select(F.col("id").alias("region"), F.explode(F.sequence(F.lit(FROM).cast("long"), F.lit(NOW - DAY).cast("long"), F.lit(DAY).cast("long"))).alias("day_s"))
    model = F.explode(F.array(*[F.struct(F.lit(s).alias("source"), F.lit(ph).alias("phase"), F.lit(sec).alias("sec")) for s, ph, sec in MODEL]))
    return days.withColumn("m", model).select("region", "m.source", (F.col("day_s") + F.col("m.sec") + F.col("region") * 300).alias("at_s"), "m.phase")


def cloud(spark: SparkSession) -> DataFrame:
    """Hours of the window: some have no value, some two, and over one region it never clears."""
    hours = spark.range(REGIONS).select(F.col("id").alias("region"), F.explode(F.sequence(F.lit(FROM // 3600).cast("long"), F.lit(NOW // 3600 - 1).cast("long"))).alias("h")).filter("(region + h) % 6 != 0")
    percent = F.when(F.col("region") == 3, 95).otherwise((F.col("region") * 37 + F.col("h") * 53) % 101)
    again = hours.filter("h % 9 = 0").select("region", "h", ((F.col("region") * 11 + F.col("h") * 7) % 101).alias("percent"))
    return hours.select("region", "h", percent.alias("percent")).unionByName(again).select("region", (F.col("h") * 3600).alias("hour_s"), "percent")


def outages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OUTAGES, "source string, from_s long, to_s long")


_VALUES = lambda rows: "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::BIGINT" for v in r) + ")" for r in rows) + ")"
_SKY = f"""
days AS (SELECT r AS region, unnest(range({FROM}, {NOW}, {DAY})) AS day_s FROM range({REGIONS}) t(r)),
hours0 AS (SELECT r AS region, unnest(range({FROM // 3600}, {NOW // 3600})) AS h FROM range({REGIONS}) t(r)), hours AS (SELECT * FROM hours0 WHERE (region + h) % 6 <> 0),
cover AS (SELECT region, h, max(pc) AS pc FROM (SELECT region, h, CASE WHEN region = 3 THEN 95 ELSE (region * 37 + h * 53) % 101 END AS pc FROM hours UNION ALL SELECT region, h, (region * 11 + h * 7) % 101 FROM hours WHERE h % 9 = 0) u GROUP BY region, h),
gone(source, from_s, to_s) AS {_VALUES(OUTAGES)}, nominal(source, phase, sec) AS {_VALUES(MODEL)},
looks0 AS (SELECT region, source, phase, day_s + sec + region * 300 AS at_s FROM days CROSS JOIN nominal UNION ALL SELECT region, 'geo_msg', 'slot', unnest(range(day_s, day_s + {DAY}, 600)) FROM days),
looks AS MATERIALIZED (SELECT l.*, EXISTS (SELECT 1 FROM gone g WHERE g.source = l.source AND l.at_s >= g.from_s AND l.at_s < coalesce(g.to_s, 9999999999)) AS frozen, c.pc FROM looks0 l LEFT JOIN cover c ON c.region = l.region AND c.h = l.at_s // 3600),
weights AS MATERIALIZED (SELECT region, source, phase, at_s, frozen, coalesce(pc > 80, TRUE) AS hidden, CASE WHEN source = 'geo_msg' THEN 50000 WHEN source LIKE 'viirs%' THEN CASE phase WHEN 'day' THEN 1000000 ELSE 1250000 END WHEN source = 'modis' THEN 500000 ELSE 750000 END // CASE WHEN pc >= 50 THEN 2 ELSE 1 END AS w, coalesce(pc >= 50, FALSE) AS half FROM looks),
declared AS MATERIALIZED ({_DECLARED})"""


def _tick_sql(i: int, since: int, at: int) -> str:
    """One tick, from carry{i} to found{i} and carry{i + 1}."""
    end_day = (at - 1) // DAY * DAY
    first, last = f"(CAST(ceil(since / {float(DAY)}) AS BIGINT) * {DAY})", (at - DAY) // DAY * DAY
    return f"""
e{i} AS MATERIALIZED (
  SELECT e.event_id, e.region, e.newest_s, e.last_frp, e.max_frp, coalesce(c.e_q, 0) AS was_q, c.geo_day_s, c.geo_q, c.blind_since_s AS was_blind, c.inactive_since_s AS was_inactive,
         CASE WHEN d.declared_s > coalesce(c.declared_s, -1) THEN d.declared_state ELSE coalesce(c.state, 'active') END AS from_state, coalesce(d.declared_s, c.declared_s) AS declared_s,
         CASE WHEN e.newest_s > coalesce(c.last_s, -1) THEN e.newest_s END AS redetected_s, CASE WHEN e.newest_s > coalesce(c.last_s, -1) THEN coalesce(c.last_s, e.newest_s) ELSE e.newest_s END AS last_s, coalesce(e.max_frp >= 100, FALSE) AS large
  FROM ({_EVENTS.format(at=at)}) e LEFT JOIN carry{i} c ON c.event_id = e.event_id
  LEFT JOIN (SELECT event_id, declared_s, declared_state, row_number() OVER (PARTITION BY event_id ORDER BY declared_s DESC, declared_state DESC) AS r FROM declared WHERE declared_s <= {at}) d ON d.event_id = e.event_id AND d.r = 1),
p{i} AS (SELECT e.event_id, sum(CASE WHEN w.at_s <= e.last_s OR w.frozen OR w.hidden THEN 0 ELSE w.w END) AS q, bool_or(w.phase = 'day' AND NOT (w.at_s <= e.last_s OR w.frozen OR w.hidden)) AS dm, bool_or(w.phase = 'night' AND NOT (w.at_s <= e.last_s OR w.frozen OR w.hidden)) AS nm,
  count(*) FILTER (WHERE w.at_s <= e.last_s OR NOT (w.frozen OR w.hidden)) AS n, max(w.at_s) FILTER (WHERE w.at_s <= e.last_s OR NOT (w.frozen OR w.hidden)) AS l
  FROM e{i} e JOIN weights w ON w.region = e.region AND w.source <> 'geo_msg' AND w.at_s >= {since} AND w.at_s < {at} GROUP BY e.event_id),
d{i} AS (SELECT region, at_s - at_s % {DAY} AS day_s, list({{'u': CASE WHEN frozen OR hidden THEN 0 ELSE w END::BIGINT, 'n': 0::BIGINT, 'c': 0::BIGINT, 'l': at_s::BIGINT}} ORDER BY at_s) AS slots FROM weights WHERE source = 'geo_msg' AND at_s >= {since} AND at_s < {at} GROUP BY 1, 2),
f{i} AS (SELECT e.event_id, d.day_s, CASE WHEN e.geo_day_s = d.day_s THEN e.geo_q ELSE 0 END AS already, list_reduce(list_prepend({{'u': CASE WHEN e.geo_day_s = d.day_s THEN e.geo_q ELSE 0 END::BIGINT, 'n': 0::BIGINT, 'c': 0::BIGINT, 'l': NULL::BIGINT}}, d.slots), lambda a, x: {{
    'u': a.u + CASE WHEN x.l > e.last_s AND x.u > 0 AND a.u + x.u <= 1000000 THEN x.u ELSE 0 END, 'n': a.n + CASE WHEN x.l > e.last_s AND x.u > 0 AND a.u + x.u <= 1000000 THEN 1 ELSE 0 END,
    'c': a.c + CASE WHEN x.l <= e.last_s OR (x.u > 0 AND a.u + x.u <= 1000000) THEN 1 ELSE 0 END, 'l': CASE WHEN x.l <= e.last_s OR (x.u > 0 AND a.u + x.u <= 1000000) THEN x.l ELSE a.l END}}) AS s
  FROM e{i} e JOIN d{i} d ON d.region = e.region WHERE e.last_frp >= 45),
g{i} AS (SELECT event_id, sum(s.u - already) AS q, sum(s.c) AS n, max(s.l) AS l, max(CASE WHEN day_s = {end_day} AND s.n > 0 THEN s.u END) AS spent FROM f{i} GROUP BY event_id),
v{i} AS (SELECT e.*, coalesce(p.q, 0) + coalesce(g.q, 0) AS added_q, coalesce(p.dm, FALSE) AS day_miss, coalesce(p.nm, FALSE) AS night_miss, coalesce(p.n, 0) + coalesce(g.n, 0) AS chances, greatest(p.l, g.l) AS chance_s, coalesce(e.was_blind, {since}) AS since,
  coalesce(g.spent, CASE WHEN e.geo_day_s = {end_day} THEN e.geo_q END) AS spent_q FROM e{i} e LEFT JOIN p{i} p ON p.event_id = e.event_id LEFT JOIN g{i} g ON g.event_id = e.event_id),
b{i} AS (SELECT *, was_q + added_q AS e_q, CASE WHEN {last} < {first} OR chance_s >= {last + DAY} THEN 0 ELSE ({last} - greatest(coalesce(chance_s - chance_s % {DAY}, {first} - {DAY}), {first} - {DAY})) // {DAY} END AS blind_days,
  coalesce(chance_s - chance_s % {DAY} + {DAY}, since) AS blind_since_s, coalesce(was_inactive, {at}) AS held, {at} - coalesce(was_inactive, {at}) AS idle, CASE WHEN large THEN 5000000 ELSE 3000000 END AS bar FROM v{i}),
o{i} AS (SELECT *, CASE WHEN redetected_s IS NOT NULL THEN CASE WHEN redetected_s - last_s <= 172800 THEN 'active|redetection|0' ELSE from_state || '|no_change|0' END
  WHEN from_state LIKE 'officially%' THEN from_state || CASE WHEN idle < 172800 THEN '|no_change|0' ELSE '|display_window|0' END WHEN from_state = 'archived' THEN 'archived|no_change|0'
  WHEN from_state = 'no_longer_detected' THEN CASE WHEN idle >= 604800 THEN 'archived|display_window|0' WHEN idle >= 172800 THEN 'no_longer_detected|display_window|0' ELSE 'no_longer_detected|no_change|0' END
  WHEN e_q >= bar AND {at} - last_s >= 86400 AND day_miss AND night_miss THEN 'no_longer_detected|miss_evidence|0' WHEN blind_days >= 14 AND {at} - last_s >= {14 * DAY} THEN 'no_longer_detected|unobservable|1'
  ELSE CASE WHEN e_q >= bar / 2 THEN 'signal_weakening' ELSE 'active' END || CASE WHEN chances = 0 THEN '|no_opportunity|0' ELSE '|insufficient_evidence|0' END END AS said FROM b{i}),
found{i} AS MATERIALIZED (SELECT *, {at} AS at_s, split_part(said, '|', 1) AS state, split_part(said, '|', 2) AS reason, split_part(said, '|', 3) = '1' AS excluded, CASE WHEN split_part(said, '|', 1) NOT IN ('active', 'signal_weakening') THEN held END AS inactive_since_s FROM o{i}),
carry{i + 1} AS MATERIALIZED (SELECT event_id, state, CASE WHEN reason = 'redetection' THEN 0 ELSE e_q END AS e_q, CASE WHEN spent_q IS NOT NULL THEN {end_day} END AS geo_day_s, spent_q AS geo_q, blind_since_s, inactive_since_s, declared_s, newest_s AS last_s FROM found{i}
  UNION ALL SELECT * FROM carry{i} WHERE event_id NOT IN (SELECT event_id FROM e{i}))"""


_NONE = "carry0 AS (SELECT NULL::BIGINT AS event_id, NULL::VARCHAR AS state, NULL::BIGINT AS e_q, NULL::BIGINT AS geo_day_s, NULL::BIGINT AS geo_q, NULL::BIGINT AS blind_since_s, NULL::BIGINT AS inactive_since_s, NULL::BIGINT AS declared_s, NULL::BIGINT AS last_s WHERE FALSE)"
_CHAIN = f"WITH {_SKY.strip()}, {_NONE}," + ",".join(_tick_sql(i, ([FROM, *TICKS])[i], at) for i, at in enumerate(TICKS))
_COLUMNS = ["event_id", "at_s", "from_state", "state", "reason", "tier", "excluded", "e_q", "chances", "blind_days", "inactive_since_s", "geo_q"]
_TIER = "CASE WHEN state = 'archived' THEN 'archive' WHEN state IN ('active', 'signal_weakening') OR at_s - inactive_since_s < 172800 THEN 'map' WHEN at_s - inactive_since_s < 604800 THEN 'feed' ELSE 'archive' END AS tier"
_FOUND = f"SELECT {', '.join({'tier': _TIER, 'geo_q': 'spent_q AS geo_q'}.get(c, c) for c in _COLUMNS)} FROM found{{i}}"


def known(members: DataFrame, moments: list[int]) -> DataFrame:
    """event_id and, for each moment in turn, k0, k1 ... as _EVENTS has them of what came before it (null: nothing), all in one pass.

    Members are dealt by event with the numbers that their uid is made of, since a uid is as long as the rest of a row.
    """
    rows = members.select(F.col("fire_id").alias("event_id"), (F.col("user_id") % REGIONS).alias("region"), "acq_s", F.col("event_id").alias("_of"), "frp")
    rows = rows.filter(F.col("acq_s") < max(moments))
    rows = rows.repartition(pieces(rows, 16), "event_id").withColumn("_last", F.struct("acq_s", F.sha2(F.col("_of").cast("string"), 256)))
    before = lambda at, x: F.when(F.col("acq_s") < at, x)
    newest = [F.max_by(F.struct("region", F.col("acq_s").alias("newest_s"), F.col("frp").alias("last_frp")), before(at, F.col("_last"))).alias(f"_n{i}") for i, at in enumerate(moments)]
    most = [F.max(before(at, F.col("frp"))).alias(f"_m{i}") for i, at in enumerate(moments)]
    one = rows.groupBy("event_id").agg(*newest, *most)
    return one.select("event_id", *[F.when(F.col(f"_n{i}").isNotNull(), F.struct(f"_n{i}.*", F.col(f"_m{i}").alias("max_frp"))).alias(f"k{i}") for i in range(len(moments))])


def ticks(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The decisions of each tick in turn; a tick's outcome is written as a table, since the next one builds on it."""
    sky = passes(spark), cloud(spark), outages(spark)
    declared = written(spark_sql(spark, sf_dir, _DECLARED), "declared")
    events = written(known(frame(spark, sf_dir, "members"), TICKS), "known")
    carry, since, out = spark.createDataFrame([], lifecycle.CARRY), FROM, []
    for i, at in enumerate(TICKS):
        found = written(lifecycle.tick(events.filter(f"k{i} IS NOT NULL").select("event_id", f"k{i}.*"), carry, declared, *sky, since, at), "tick")
        if at != TICKS[-1]:
            carry, since = written(lifecycle.carried(found, carry), "carry"), at
        out.append(found.withColumn("at_s", F.lit(at).cast("long")))
    return out


@query("str_14_lifecycle_ticks", _CHAIN + " " + " UNION ALL ".join(_FOUND.format(i=i) for i in range(len(TICKS))))
def lifecycle_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, *others = (t.select(*_COLUMNS) for t in ticks(spark, sf_dir))
    for t in others:
        first = first.unionByName(t)
    return first


def _fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the first tick, not yet weighed: their newest detection is what they were last seen by."""
    null = F.lit(None).cast("long")
    events = spark_sql(spark, sf_dir, _EVENTS.format(at=TICKS[0]))
    return events.withColumnRenamed("newest_s", "last_s").withColumns({"e_q": F.lit(0).cast("long"), "geo_day_s": null, "geo_q": null, "blind_since_s": null})


_FIRST = f"WITH {_SKY.strip()}, {_NONE}," + _tick_sql(0, FROM, TICKS[0])


@query("str_07_miss_evidence", _FIRST + " SELECT event_id, added_q, e_q, day_miss, night_miss, chances, blind_days, blind_since_s, spent_q AS geo_q FROM found0")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lifecycle.miss_evidence(_fresh(spark, sf_dir), passes(spark), cloud(spark), outages(spark), FROM, TICKS[0])
    return found.select("event_id", "added_q", "e_q", "day_miss", "night_miss", "chances", "blind_days", "blind_since_s", "geo_q")


@query("str_08_verdicts_of_passes", _FIRST + f"""
SELECT e.event_id, w.source, w.at_s, w.phase, CASE WHEN w.at_s <= e.last_s THEN 'detected' WHEN w.frozen THEN 'source_frozen' WHEN w.hidden THEN 'cloud_blocked' WHEN w.half THEN 'half_weight' ELSE 'counted' END AS verdict,
       CASE WHEN w.at_s <= e.last_s OR w.frozen OR w.hidden THEN 0 ELSE w.w END AS weight_q FROM e0 e JOIN weights w ON w.region = e.region AND w.source <> 'geo_msg' AND w.at_s < {TICKS[0]}""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    looks = lifecycle.banded(passes(spark).filter(F.col("at_s") < TICKS[0]), cloud(spark), outages(spark))
    return lifecycle.pass_verdicts(_fresh(spark, sf_dir), looks)


@query("str_13_large_events", f"SELECT fire_id, n * 14 >= {p.LARGE_HA} OR coalesce(max_frp >= {p.LARGE_MW}, FALSE) OR fire_id % 29 = 0 AS large FROM fires")
def large(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, sf_dir, "fires")
    return f.select("fire_id", lifecycle.is_large(F.col("n") * 14, F.col("max_frp"), F.col("fire_id") % 29 == 0).alias("large"))


_WATCH = NOW - 30 * DAY
#: Ticks of the digest, every three hours of six days; clocks in Sofia are two hours ahead then.
_DIGEST_TICKS = [NOW - 6 * DAY + k * 10_800 for k in range(48)]
_LOCAL = "({} + 7200) % 86400 // 60"


def digest_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    accounts = spark_sql(spark, sf_dir, f"SELECT account_id, 'Europe/Sofia' AS timezone, {_WATCH} + account_id % 30 * {DAY} AS watching_s FROM zones GROUP BY account_id")
    zones = spark_sql(spark, sf_dir, "SELECT account_id, CASE zone_id % 40 WHEN 0 THEN '22:00' WHEN 1 THEN '08:00' ELSE '06:00' END AS quiet_from, CASE zone_id % 40 WHEN 0 THEN '11:30' WHEN 1 THEN '09:15' ELSE '06:00' END AS quiet_to FROM zones")
    return accounts, zones, spark_sql(spark, sf_dir, _OWED)


_OWED = f"""
SELECT z.account_id, z.zone_id, f.fire_id AS event_id, (f.fire_id * 37 + z.zone_id * 53) % 9000 AS distance_m, CASE (f.fire_id + z.zone_id) % 3 WHEN 0 THEN 'deferred' WHEN 1 THEN 'seeded' ELSE 'active' END AS kind,
       {NOW} - f.fire_id % 9 * 43200 AS since_s, CASE WHEN f.fire_id % 4 > 0 THEN {NOW} - f.fire_id % 9 * 43200 + f.fire_id % 5 * 70000 END AS until_s
FROM fires f JOIN zones z ON z.zone_id = f.fire_id % 1499 + 1"""


@query("str_18_daily_digests", f"""
WITH acc AS (SELECT account_id, {_WATCH} + account_id % 30 * {DAY} AS watching_s FROM zones GROUP BY account_id), owed AS ({_OWED}),
t AS (SELECT a.account_id, at_s, at_s - (at_s + 7200 - 32400) % 86400 AS start_s, watching_s FROM acc a CROSS JOIN (VALUES {", ".join(f"({t})" for t in _DIGEST_TICKS)}) v(at_s)),
q AS (SELECT t.*, EXISTS (SELECT 1 FROM zones z WHERE z.account_id = t.account_id AND ((z.zone_id % 40 = 0 AND ({_LOCAL.format("t.at_s")} >= 1320 OR {_LOCAL.format("t.at_s")} < 690)) OR (z.zone_id % 40 = 1 AND {_LOCAL.format("t.at_s")} BETWEEN 480 AND 554))) AS quiet FROM t WHERE start_s >= watching_s),
u AS (SELECT account_id, start_s, min(at_s) AS at_s FROM q WHERE NOT quiet GROUP BY account_id, start_s), w AS (SELECT *, lag(start_s) OVER (PARTITION BY account_id ORDER BY start_s) AS last_s FROM u),
l AS (SELECT w.account_id, w.start_s, o.event_id, o.zone_id, o.distance_m, o.kind, row_number() OVER (PARTITION BY w.account_id, w.start_s, o.event_id ORDER BY o.distance_m, o.zone_id, CASE o.kind WHEN 'deferred' THEN 0 WHEN 'seeded' THEN 1 ELSE 2 END) AS r
      FROM w JOIN owed o ON o.account_id = w.account_id AND o.since_s <= w.at_s AND (o.until_s IS NULL OR o.until_s > w.at_s) AND CASE o.kind WHEN 'deferred' THEN w.last_s IS NULL OR o.since_s >= w.last_s WHEN 'seeded' THEN o.since_s < w.start_s ELSE TRUE END)
SELECT account_id, start_s, event_id, zone_id, distance_m, kind FROM l WHERE r = 1""")
def daily_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all digests of six days, with quiet hours that some accounts have in the morning."""
    return digest.lines(*digest_tables(spark, sf_dir), _DIGEST_TICKS)


@query("str_18_digest_decisions", f"""
WITH acc AS (SELECT account_id, {_WATCH} + account_id % 30 * {DAY} AS watching_s FROM zones GROUP BY account_id), owed AS ({_OWED}),
t AS (SELECT a.account_id, at_s, at_s - (at_s + 7200 - 32400) % 86400 AS start_s, watching_s FROM acc a CROSS JOIN (VALUES {", ".join(f"({t})" for t in _DIGEST_TICKS)}) v(at_s)),
q AS (SELECT t.*, start_s >= watching_s AS due, EXISTS (SELECT 1 FROM zones z WHERE z.account_id = t.account_id AND ((z.zone_id % 40 = 0 AND ({_LOCAL.format("t.at_s")} >= 1320 OR {_LOCAL.format("t.at_s")} < 690)) OR (z.zone_id % 40 = 1 AND {_LOCAL.format("t.at_s")} BETWEEN 480 AND 554))) AS quiet FROM t),
u AS (SELECT account_id, start_s, min(at_s) AS used_s FROM q WHERE due AND NOT quiet GROUP BY account_id, start_s), w AS (SELECT *, lag(start_s) OVER (PARTITION BY account_id ORDER BY start_s) AS last_s FROM u),
n AS (SELECT w.account_id, w.start_s, count(DISTINCT o.event_id) AS n FROM w JOIN owed o ON o.account_id = w.account_id AND o.since_s <= w.used_s AND (o.until_s IS NULL OR o.until_s > w.used_s) AND CASE o.kind WHEN 'deferred' THEN w.last_s IS NULL OR o.since_s >= w.last_s WHEN 'seeded' THEN o.since_s < w.start_s ELSE TRUE END GROUP BY 1, 2),
d AS (SELECT q.account_id, q.at_s, q.start_s, CASE WHEN NOT due OR q.at_s > w.used_s THEN 'none' WHEN w.used_s IS NULL OR q.at_s < w.used_s THEN 'hold' WHEN n.n > 0 THEN 'send' ELSE 'suppress' END AS outcome, n.n FROM q LEFT JOIN w ON w.account_id = q.account_id AND w.start_s = q.start_s AND due LEFT JOIN n ON n.account_id = q.account_id AND n.start_s = q.start_s)
SELECT account_id, at_s, CASE WHEN outcome <> 'none' THEN start_s END AS start_s, outcome, CASE WHEN outcome = 'send' THEN n ELSE 0 END::BIGINT AS entries FROM d""")
def digest_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each account's digest does at each tick: send, hold in quiet hours, suppress for want of news, or nothing."""
    return digest.decisions(*digest_tables(spark, sf_dir), _DIGEST_TICKS)


_TICK = NOW - 12 * DAY
_PAST = f"SELECT fire_id, min(acq_s) AS started_s, max(acq_s) AS last_s, count(*) AS n FROM members WHERE acq_s < {_TICK} GROUP BY fire_id"
#: The registry before a tick, with a few tombstones, and what the tick found: later aggregates, new events, and merges with the event before.
_BEFORE = f"SELECT fire_id AS event_id, CASE WHEN fire_id % 23 = 5 AND lag(fire_id) OVER (ORDER BY fire_id) = fire_id - 1 THEN fire_id - 1 END AS merged_into, started_s, last_s, n FROM ({_PAST}) x"
_STATES = "SELECT event_id, event_id % 7 + k AS zone_id, CAST((event_id + k) % 4 AS INT) AS rank, CASE WHEN event_id % 3 > 0 THEN last_s END AS notified_s FROM before0 CROSS JOIN (VALUES (0), (1)) AS t(k) WHERE merged_into IS NULL"
_MERGES = "SELECT fire_id AS absorbed, fire_id - 1 AS survivor FROM (SELECT fire_id, lag(fire_id) OVER (ORDER BY fire_id) AS p FROM fires) x WHERE p = fire_id - 1 AND fire_id % 17 IN (0, 1)"
#: _BEFORE and _MERGES for Spark: whether there is a fire of the number before is asked by a join, not by a window over all fires in one task.
_BEFORE_FOUND = f"WITH past AS ({_PAST}) SELECT x.fire_id AS event_id, y.fire_id AS merged_into, x.started_s, x.last_s, x.n FROM past x LEFT JOIN past y ON y.fire_id + 1 = x.fire_id AND x.fire_id % 23 = 5 AND (y.fire_id + 1) % 23 = 5"
_MERGES_FOUND = "SELECT fire_id AS absorbed, fire_id - 1 AS survivor FROM fires f WHERE fire_id % 17 IN (0, 1) AND EXISTS (SELECT 1 FROM fires o WHERE o.fire_id + 1 = f.fire_id AND (o.fire_id + 1) % 17 IN (0, 1))"


@query("str_06_write_plan", f"""
WITH RECURSIVE b AS MATERIALIZED ({_BEFORE}), st AS MATERIALIZED ({_STATES.replace("before0", "b")}), mg AS MATERIALIZED ({_MERGES}),
links AS MATERIALIZED (SELECT absorbed, survivor FROM mg UNION ALL SELECT event_id, merged_into FROM b WHERE merged_into IS NOT NULL AND event_id NOT IN (SELECT absorbed FROM mg)),
walk(e, t) AS (SELECT absorbed, survivor FROM links UNION ALL SELECT w.e, l.survivor FROM walk w JOIN links l ON l.absorbed = w.t),
ends AS MATERIALIZED (SELECT e, t FROM walk WHERE t NOT IN (SELECT absorbed FROM links)),
fold AS (SELECT coalesce(ends.t, st.event_id) AS event_id, zone_id, max(rank) AS rank, max(notified_s) AS notified_s, count(ends.e) AS moved FROM st LEFT JOIN ends ON ends.e = st.event_id GROUP BY 1, 2),
p AS (
  SELECT 1 AS step, 'seed' AS action, f.fire_id AS event_id, NULL::BIGINT AS zone_id, NULL AS uid, NULL::BIGINT AS merged_into, f.started_s, f.last_s, f.n, NULL::INT AS rank, NULL::BIGINT AS notified_s FROM fires f WHERE fire_id NOT IN (SELECT event_id FROM b)
  UNION ALL SELECT 2, 'tombstone', ends.e, NULL, NULL, ends.t, NULL, NULL, NULL, NULL, NULL FROM ends LEFT JOIN b ON b.event_id = ends.e WHERE b.merged_into IS DISTINCT FROM ends.t
  UNION ALL SELECT 3, 'delete_state', st.event_id, st.zone_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM st JOIN ends ON ends.e = st.event_id
  UNION ALL SELECT 4, 'upsert_state', fold.event_id, fold.zone_id, NULL, NULL, NULL, NULL, NULL, fold.rank, fold.notified_s FROM fold LEFT JOIN st ON st.event_id = fold.event_id AND st.zone_id = fold.zone_id WHERE moved > 0 AND (st.event_id IS NULL OR st.rank IS DISTINCT FROM fold.rank OR st.notified_s IS DISTINCT FROM fold.notified_s)
  UNION ALL SELECT 5, 'add_member', coalesce(ends.t, m.fire_id), NULL, m.uid, NULL, NULL, NULL, NULL, NULL, NULL FROM members m LEFT JOIN ends ON ends.e = m.fire_id WHERE m.acq_s >= {_TICK}
  UNION ALL SELECT 6, 'aggregate', f.fire_id, NULL, NULL, NULL, f.started_s, f.last_s, f.n, NULL, NULL FROM fires f JOIN b ON b.event_id = f.fire_id WHERE f.fire_id NOT IN (SELECT e FROM ends) AND (f.started_s <> b.started_s OR f.last_s <> b.last_s OR f.n <> b.n))
SELECT step::INT AS step, action, event_id, zone_id, uid, merged_into, started_s, last_s, n, rank, notified_s FROM p""")
def write_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All writes that a tick implies for the registry as it was before."""
    of = lambda text: spark_sql(spark, sf_dir, text)
    before = written(of(_BEFORE_FOUND), "before")
    states = spark_sql(spark, sf_dir, _STATES.replace("before0", "{before0}"), before0=before)
    held = of(f"SELECT uid, fire_id AS event_id FROM members WHERE acq_s < {_TICK}")
    clusters = of("SELECT fire_id AS event_id, started_s, last_s, n FROM fires")
    return registry.write_plan(before, states, held, clusters, of(_MERGES_FOUND), of("SELECT uid, fire_id AS event_id FROM members"))


#: Events in every state, with evidence, misses and blind days of all sizes.
_STANDING = f"""
SELECT fire_id AS event_id, CASE fire_id * 31 % 7 WHEN 0 THEN 'no_longer_detected' WHEN 1 THEN 'archived' WHEN 2 THEN 'officially_contained' WHEN 3 THEN 'signal_weakening' ELSE 'active' END AS state, last_s,
       CASE WHEN fire_id % 5 = 0 THEN last_s + (fire_id * 7 % 60) * 3600 END AS redetected_s, fire_id * 7919 % 6500 * 1000 AS e_q, max_frp >= {p.LARGE_MW} OR fire_id % 9 = 0 AS large, fire_id % 4 > 0 AS day_miss, fire_id % 6 > 0 AS night_miss,
       fire_id * 11 % 3 AS chances, fire_id * 13 % 20 AS blind_days, CASE WHEN fire_id % 8 > 0 THEN {NOW} - (fire_id * 17 % 500) * 3600 END AS inactive_since_s FROM fires"""
_SHOWN = f"CASE WHEN {NOW} - held < {p.MAP_H * HOUR} THEN 'no_change' ELSE 'display_window' END"


@query("str_11_decided", f"""
WITH e AS ({_STANDING}), c AS (SELECT *, {NOW} - last_s AS idle, coalesce(inactive_since_s, {NOW}) AS held, CASE WHEN large THEN {p.CLOSE_LARGE_Q} ELSE {p.CLOSE_Q} END AS close_q FROM e),
tried AS (SELECT event_id, 1 AS rank, 'active' AS state, 'redetection' AS reason FROM c WHERE redetected_s <= last_s + {p.T_LINK_H * HOUR}
  UNION ALL SELECT event_id, 2, state, 'no_change' FROM c WHERE redetected_s IS NOT NULL
  UNION ALL SELECT event_id, 3, state, {_SHOWN} FROM c WHERE state = 'officially_contained'
  UNION ALL SELECT event_id, 4, state, 'no_change' FROM c WHERE state = 'archived'
  UNION ALL SELECT event_id, 5, CASE WHEN {NOW} - held >= {p.FEED_H * HOUR} THEN 'archived' ELSE state END, {_SHOWN} FROM c WHERE state = 'no_longer_detected'
  UNION ALL SELECT event_id, 6, 'no_longer_detected', 'miss_evidence' FROM c WHERE e_q >= close_q AND idle >= {p.QUIET_H * HOUR} AND day_miss AND night_miss
  UNION ALL SELECT event_id, 7, 'no_longer_detected', 'unobservable' FROM c WHERE blind_days >= {p.BLIND_DAYS} AND idle >= {p.BLIND_DAYS * DAY}
  UNION ALL SELECT event_id, 8, CASE WHEN 2 * e_q >= close_q THEN 'signal_weakening' ELSE 'active' END, CASE chances WHEN 0 THEN 'no_opportunity' ELSE 'insufficient_evidence' END FROM c),
first AS (SELECT event_id, arg_min(state, rank) AS state, arg_min(reason, rank) AS reason FROM tried GROUP BY event_id)
SELECT c.event_id, c.state AS from_state, f.state, f.reason, f.reason = 'unobservable' AS excluded, CASE WHEN f.state IN ('active', 'signal_weakening') THEN 'map' WHEN f.state = 'archived' OR {NOW} - c.held >= {p.FEED_H * HOUR} THEN 'archive' WHEN {NOW} - c.held >= {p.MAP_H * HOUR} THEN 'feed' ELSE 'map' END AS tier
FROM c JOIN first f ON f.event_id = c.event_id""")
def decided_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that every event moves to, by the rules in order of authority."""
    return lifecycle.decided(spark_sql(spark, sf_dir, _STANDING), NOW).select("event_id", "from_state", "state", "reason", "excluded", "tier")
