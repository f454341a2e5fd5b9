"""Queries that run streams over the driver's tables: change feeds, sliding retention, and what they leave behind."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline import params as p
from emberline.operators import scoring
from emberline.operators.graph import shared_folder
from emberline.plans.catalog import frame, query, spark_sql
from emberline.plans.formats import _UID
from emberline.plans.scalars import _RULES
from emberline.streaming import changes as changes_
from emberline.streaming import ingest, pump, retention, state

_CHANGES = """
SELECT transition_id AS seq, public_id AS event_id, to_status AS status, CASE WHEN transition_id % 7 = 0 THEN 'feed' ELSE 'map' END AS tier,
       CASE WHEN transition_id % 37 = 0 THEN public_id + 1 END AS merged_into, transition_id % 29 = 0 AS invalidated
FROM transitions"""

_FRAMES_SQL = f"""
w AS (SELECT *, merged_into IS NULL AND tier = 'map' AND NOT invalidated AS on_map FROM ({_CHANGES}) c),
l AS (SELECT *, coalesce(lag(on_map) OVER e, FALSE) AS was, lag(status) OVER e AS before FROM w WINDOW e AS (PARTITION BY event_id ORDER BY seq)),
fr AS (SELECT seq, CASE WHEN merged_into IS NOT NULL THEN 'merged' WHEN NOT was THEN 'created' WHEN before <> status THEN 'status_changed' ELSE 'updated' END AS kind, event_id, status, before, merged_into FROM l WHERE merged_into IS NOT NULL OR on_map)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, _CHANGES)


@query("str_24_pumped_frames", f"WITH {_FRAMES_SQL} SELECT seq, kind, event_id, status, CASE WHEN kind = 'status_changed' THEN before END AS previous_status, merged_into FROM fr")
def pumped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes land as a table, the pump's stream turns them into frames, in batches of a third of the sequence numbers, and stops when none are left."""
    where = shared_folder(spark, "pump")
    changes(spark, sf_dir).write.parquet(f"{where}/changes")
    landed = spark.read.parquet(f"{where}/changes")
    top = landed.agg(F.max("seq")).first()[0] or 0
    stream = pump.pump(spark, f"{where}/changes", where, max(1, top // 3 + 1))
    try:
        stream.processAllAvailable()
    finally:
        stream.stop()
    return spark.read.schema(pump.FRAMES).parquet(f"{where}/frames")


@query("str_24_client_replays", f"""
WITH {_FRAMES_SQL}, r AS (SELECT seq, row_number() OVER (ORDER BY seq DESC) AS k FROM fr), b AS (SELECT coalesce(max(seq) FILTER (WHERE k = 1001), 0) AS floor, coalesce(max(seq), 0) AS newest FROM r),
c AS (SELECT c_custkey AS client_id, CASE WHEN c_custkey % 11 > 0 THEN (SELECT newest FROM b) + 50 - c_custkey % 400 * 17 END AS last_seq FROM {{customer}})
SELECT client_id, CASE WHEN last_seq IS NULL OR last_seq < 0 OR last_seq > newest THEN 'unknown' WHEN last_seq < floor THEN 'too_old' ELSE 'replay' END AS outcome,
       CASE WHEN last_seq IS NOT NULL AND last_seq >= floor AND last_seq <= newest THEN (SELECT count(*) FROM r WHERE k <= 1000 AND r.seq > c.last_seq) ELSE 0 END AS frames FROM c CROSS JOIN b""")
def client_replays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What clients that come back with the last number they saw are sent from a ring of a thousand frames."""
    found = pump.frames(changes(spark, sf_dir))
    newest = F.broadcast(found.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("newest")))
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").crossJoin(newest)  # one row
    clients = c.select(F.col("c_custkey").alias("client_id"), F.when(F.col("c_custkey") % 11 > 0, F.col("newest") + 50 - F.col("c_custkey") % 400 * 17).alias("last_seq"))
    return pump.replays(found, clients, 1000)


#: Windows of ten minutes; some are fetched again with a later publication, some have none; two days are held.
_PRODUCTS = """
SELECT acq_s - acq_s % 600 AS start_s, acq_s - acq_s % 600 + 600 AS end_s, uid AS id, CASE WHEN event_id % 7 > 0 THEN available_s - available_s % 3600 END AS published_s, available_s, acq_s AS at_s, lon_e5 AS x, lat_e5 AS y
FROM detections"""
_KEPT_S = 10 * 86400


@query("str_34_sliding_retention", f"""
WITH pr AS ({_PRODUCTS}), n AS (SELECT max(end_s) AS now_s FROM pr), r AS (SELECT pr.*, row_number() OVER (PARTITION BY start_s ORDER BY coalesce(published_s, -1) DESC, available_s DESC, id DESC) AS k FROM pr CROSS JOIN n WHERE end_s > now_s - {_KEPT_S})
SELECT start_s, end_s, id, published_s, available_s, CASE WHEN at_s > (SELECT now_s FROM n) - {_KEPT_S} THEN 1 ELSE 0 END AS flashes FROM r WHERE k = 1""")
def sliding_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products land in files in the order of arrival, a stream merges them by window and forgets what is past the retention."""
    where = shared_folder(spark, "retention")
    found = spark_sql(spark, sf_dir, _PRODUCTS)
    shaped = found.select("start_s", "end_s", "id", "published_s", "available_s", F.array(F.struct("at_s", "x", "y")).alias("flashes"))
    shaped.repartitionByRange(8, "end_s").sortWithinPartitions("end_s", "available_s").write.json(f"{where}/landing")
    retention.slide(spark, f"{where}/landing", where, _KEPT_S, files=64).awaitTermination()
    now_s = found.agg(F.max("end_s")).first()[0] or 0
    kept = retention.document(spark, where, now_s, _KEPT_S)
    return kept.withColumn("flashes", F.size("flashes"))


@query("src_07_polled_archive", "SELECT DISTINCT " + _UID + " AS uid, CASE WHEN " + " OR ".join(f"({r})" for _, r in _RULES) + " THEN 'quarantined' ELSE 'archived' END AS verdict FROM detections WHERE source = 'viirs_snpp'")
def polled_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a source land, with when each row arrived; two runs of the ingest stream validate them into archive and quarantine, and a third finds nothing new."""
    where, at = shared_folder(spark, "polls"), F.timestamp_seconds("acq_s")
    d = frame(spark, sf_dir, "detections").filter("source = 'viirs_snpp'")
    five = lambda c: F.format_string("%.5f", c)
    rows = d.select(
        five("lat").alias("latitude"), five("lon").alias("longitude"), F.col("brightness_k").alias("bright_ti4"), F.col("scan_km").alias("scan"), F.col("track_km").alias("track"), F.date_format(at, "yyyy-MM-dd").alias("acq_date"), F.date_format(at, "HHmm").alias("acq_time"),
        F.lit("N").alias("satellite"), F.substring("confidence", 1, 1).alias("confidence"), F.lit("2").alias("version"), F.lit(None).cast("string").alias("bright_ti5"), F.col("frp"), F.col("day_night").alias("daynight"), F.col("available_s").alias("arrived"), F.col("event_id").alias("k"),
    )
    for half in (0, 1, 1):
        rows.filter(f"k % 2 = {half}").drop("k").repartition(4).write.mode("append").csv(f"{where}/landing", header=True)
        ingest.ingest_stream(spark, f"{where}/landing", where, "viirs_snpp", "arrived").awaitTermination()
    told = lambda name, verdict: spark.read.parquet(f"{where}/{name}").select("uid", F.lit(verdict).alias("verdict"))
    return told("archive", "archived").unionByName(told("quarantine", "quarantined").distinct())


@query("str_17_consumed_changes", """
WITH t AS (SELECT *, transition_id % 2 AS half FROM transitions), n AS (SELECT public_id, max(transition_id) AS seq, max_by(to_status, transition_id) AS status, half FROM t GROUP BY public_id, half), f AS (SELECT public_id, max(seq) FILTER (WHERE half = 0) AS first FROM n GROUP BY public_id)
SELECT n.public_id AS key, n.seq, n.status FROM n LEFT JOIN f ON f.public_id = n.public_id WHERE n.status <> 'P' AND (half = 0 OR first IS NULL OR n.seq > first)""")
def consumed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes land in two parts, the even numbers first; a consumer takes the newest of each key once, and late ones never."""
    where = shared_folder(spark, "consumer")
    rows = spark_sql(spark, sf_dir, "SELECT public_id AS key, transition_id AS seq, to_status AS status FROM transitions")
    for half in (0, 1):
        rows.filter(f"seq % 2 = {half}").write.mode("append").json(f"{where}/landing")
        changes_.consume(spark, f"{where}/landing", "key long, seq long, status string", where, lambda df: df.filter("row.status != 'P'").select("key", "seq", F.col("row.status").alias("status")), files=1000).awaitTermination()
    return spark.read.parquet(f"{where}/outbox").select("key", "seq", "status")


def _in_two_runs(rows: DataFrame, of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stateful stream makes of rows (at_s among them) that land in two parts, the earlier first, with a restart between."""
    spark, where = rows.sparkSession, shared_folder(rows.sparkSession, "runs")
    schema = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes)
    middle = rows.agg(((F.min("at_s") + F.max("at_s")) / 2).cast("long")).first()[0] or 0
    for part in (f"at_s <= {middle}", f"at_s > {middle}"):
        rows.filter(part).write.mode("append").json(f"{where}/landing")
        made = of(spark.readStream.schema(schema).json(f"{where}/landing"))
        made.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/offsets").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{where}/out")


_SAMPLES = "SELECT user_id % 40 AS k, acq_s AS at_s, max(event_id % 3) > 0 AS bad FROM detections GROUP BY 1, 2"


@query("str_28_demotions", f"""
WITH RECURSIVE s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY k ORDER BY at_s) AS i FROM ({_SAMPLES}) t),
run(k, i, at_s, mode, since) AS (
  SELECT k, 0::BIGINT, 0::BIGINT, 'full', -1::BIGINT FROM s GROUP BY k
  UNION ALL SELECT k, i, at_s, CASE WHEN NOT against OR at_s - began < need THEN mode WHEN mode = 'full' THEN 'reduced' ELSE 'full' END, CASE WHEN NOT against OR at_s - began >= need THEN -1 ELSE began END
  FROM (SELECT s.k, s.i, s.at_s, r.mode, (r.mode = 'full') = s.bad AS against, CASE WHEN r.since < 0 THEN s.at_s ELSE r.since END AS began, CASE r.mode WHEN 'full' THEN 300 ELSE 1800 END AS need FROM run r JOIN s ON s.k = r.k AND s.i = r.i + 1) x)
SELECT CAST(k AS VARCHAR) AS key, at_s, mode FROM run WHERE i > 0""")
def demotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode of each of forty readers after each of its samples."""
    return _in_two_runs(spark_sql(spark, sf_dir, _SAMPLES).select(F.col("k").cast("string").alias("key"), "at_s", "bad"), state.demotions)


@query("udf_24_rate_limited", """
WITH RECURSIVE h AS MATERIALIZED (SELECT user_id % 40 AS k, acq_s AS at_s, row_number() OVER (PARTITION BY user_id % 40 ORDER BY acq_s, event_id) AS i FROM detections),
run(k, i, at_s, first, n) AS (
  SELECT k, 0::BIGINT, 0::BIGINT, -1::BIGINT, 0::BIGINT FROM h GROUP BY k
  UNION ALL SELECT h.k, h.i, h.at_s, CASE WHEN r.first < 0 OR h.at_s - r.first >= 86400 THEN h.at_s ELSE r.first END, CASE WHEN r.first < 0 OR h.at_s - r.first >= 86400 THEN 1 ELSE r.n + 1 END FROM run r JOIN h ON h.k = r.k AND h.i = r.i + 1)
SELECT CAST(k AS VARCHAR) AS key, at_s, n <= 4 AS allowed FROM run WHERE i > 0""")
def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which hits of each of forty keys are allowed, four in a day that the first hit begins."""
    hits = frame(spark, sf_dir, "detections").select((F.col("user_id") % 40).cast("string").alias("key"), F.col("acq_s").alias("at_s"))
    return _in_two_runs(hits, lambda df: state.rate_limited(df, 4, 86_400))


_FEATURES = """
SELECT fire_id, score AS best, CAST(n % 4 AS DOUBLE) / 3 AS persist, CAST(fire_id % 2 AS DOUBLE) AS multisource, CAST(fire_id % 3 AS DOUBLE) / 2 AS night, CAST(fire_id % 5 AS DOUBLE) / 4 AS coherence, max_frp / 500 AS frp, CAST(fire_id % 7 AS DOUBLE) / 6 AS edge, CAST(fire_id % 11 AS DOUBLE) / 10 AS glint
FROM fires"""


@query("geo_33_linear_scores", f"SELECT fire_id, CAST(floor(({p.WEIGHTS['intercept']}::DOUBLE + " + " + ".join(f"{k} * {w}::DOUBLE" for k, w in p.WEIGHTS.items() if k != "intercept") + f") * 100000 + 0.5) AS BIGINT) AS z_e5 FROM ({_FEATURES}) f")
def linear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, _FEATURES).select("fire_id", F.floor(scoring.linear() * 100000 + 0.5).cast("long").alias("z_e5"))
