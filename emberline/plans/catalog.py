"""How queries are registered, and the domain frames that they read.

A frame is a table expression over the driver's tables, made of whole-number arithmetic so that any SQL engine agrees on
it.  A query is a DataFrame function with the same result as SQL beside it, or one statement that both engines run.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberline.operators.graph import pieces
from emberline.operators.joins import HELD

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: {sha(x)}, {epoch(ts)} and {tables} differ between engines; everything else doesn't.
FRAMES = {
    "detections": """
        SELECT event_id, user_id, {sha(CAST(event_id AS VARCHAR(20)))} AS uid,
               CASE event_type WHEN 'click' THEN 'viirs_noaa20' WHEN 'view' THEN 'viirs_snpp' WHEN 'purchase' THEN 'viirs_noaa21' WHEN 'signup' THEN 'modis' ELSE 'geo_msg' END AS source,
               {epoch(ts)} - {epoch(ts)} % 60 AS acq_s, {epoch(ts)} - {epoch(ts)} % 60 + (event_id % 180) * 60 AS available_s,
               4100000 + (user_id * 37 % 300) * 1000 + (event_id % 7) * 100 AS lat_e5, 2250000 + (user_id * 53 % 600) * 1000 + (event_id % 5) * 100 AS lon_e5,
               CAST(4100000 + (user_id * 37 % 300) * 1000 + (event_id % 7) * 100 AS DOUBLE) / 100000 AS lat, CAST(2250000 + (user_id * 53 % 600) * 1000 + (event_id % 5) * 100 AS DOUBLE) / 100000 AS lon,
               value AS frp, CASE WHEN value < 50 THEN 'low' WHEN value < 200 THEN 'nominal' ELSE 'high' END AS confidence,
               CASE WHEN {epoch(ts)} % 86400 BETWEEN 21600 AND 64799 THEN 'D' ELSE 'N' END AS day_night,
               CAST(0.375 AS DOUBLE) * (1 + event_id % 3) AS scan_km, CAST(0.375 AS DOUBLE) * (1 + event_id % 2) AS track_km,
               event_id % 11 = 0 AS over_water, 140 + event_id % 500 AS brightness_k, CASE WHEN event_id % 9 = 0 THEN 'SP' ELSE 'NRT' END AS tier, event_id % 23 = 0 AS quarantined
        FROM {events}""",
    "members": """
        SELECT d.*, user_id * 1000 + CAST(sum(starts) OVER (PARTITION BY user_id ORDER BY acq_s, uid ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fire_id
        FROM (SELECT *, CASE WHEN acq_s - lag(acq_s) OVER (PARTITION BY user_id ORDER BY acq_s, uid) <= 21600 THEN 0 ELSE 1 END AS starts FROM detections) d""",
    "fires": """
        SELECT fire_id, min(acq_s) AS started_s, max(acq_s) AS last_s, count(*) AS n, max(frp) AS max_frp,
               CAST(floor(avg(lat_e5) + 0.5) AS BIGINT) AS lat_e5, CAST(floor(avg(lon_e5) + 0.5) AS BIGINT) AS lon_e5,
               CAST(floor(avg(lat_e5) + 0.5) AS DOUBLE) / 100000 AS lat, CAST(floor(avg(lon_e5) + 0.5) AS DOUBLE) / 100000 AS lon,
               CAST(fire_id * 37 % 100 AS DOUBLE) / 100 AS score, fire_id * 7919 % 100003 AS seq, fire_id % 13 = 0 AS invalidated,
               CASE WHEN fire_id % 17 = 0 THEN fire_id - 1 END AS merged_into, CASE fire_id % 3 WHEN 0 THEN 'map' WHEN 1 THEN 'feed' ELSE 'archive' END AS tier,
               CASE fire_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'signal_weakening' WHEN 2 THEN 'no_longer_detected' ELSE 'officially_extinguished' END AS status
        FROM members GROUP BY fire_id""",
    "zones": """
        SELECT c_custkey AS zone_id, c_nationkey AS account_id, 4100000 + (c_custkey * 7919 % 300) * 1000 AS lat_e5, 2250000 + (c_custkey * 104729 % 600) * 1000 AS lon_e5,
               CAST(4100000 + (c_custkey * 7919 % 300) * 1000 AS DOUBLE) / 100000 AS lat, CAST(2250000 + (c_custkey * 104729 % 600) * 1000 AS DOUBLE) / 100000 AS lon,
               2000 + (c_custkey * 31 % 29) * 1000 AS radius_m, CAST(CASE c_custkey % 3 WHEN 0 THEN 0.3 WHEN 1 THEN 0.45 ELSE 0.75 END AS DOUBLE) AS min_score, 1704067200 + (c_custkey % 30) * 86400 AS created_s
        FROM {customer}""",
    "transitions": """
        SELECT o_orderkey AS transition_id, o_custkey AS public_id, {epoch(o_orderdate)} AS at_s, o_orderstatus AS to_status,
               CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END AS state_rank, o_totalprice AS weight
        FROM {orders}""",
    "lags": """
        SELECT l_returnflag AS source, {epoch(o_orderdate)} AS acq_s, {epoch(l_shipdate)} AS available_s, {epoch(l_shipdate)} - {epoch(o_orderdate)} AS lag_s
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "aliases": """SELECT p_partkey AS alias, CASE WHEN p_partkey % 5 <> 0 AND p_partkey > 3 THEN p_partkey - p_partkey % 3 - 2 END AS merged_into FROM {part}""",
}


def _needed(text: str) -> list[str]:
    found: list[str] = []

    def add(t: str) -> None:
        for name in FRAMES:
            if re.search(rf"\b{name}\b", t) and name not in found:
                add(FRAMES[name])
                found.append(name)

    add(text)
    return found


#: For Spark: members are numbered over events that are dealt by user as they were read, before what is derived widens them.
_DEALT = FRAMES | {
    "dealt": FRAMES["detections"].replace("{events}", "(SELECT /*+ REPARTITION({pieces}, user_id) */ event_id, ts, user_id, event_type, value FROM {events})"),
    "members": FRAMES["members"].replace("FROM detections", "FROM dealt"),
}


def _full(text: str, known: dict[str, str] = FRAMES) -> str:
    needed = _needed(text)
    if "members" in needed and "dealt" in known:
        needed.insert(needed.index("members"), "dealt")
    frames = [f"{n} AS ({known[n]})" for n in needed]
    text = text.strip()
    if not frames:
        return text
    recursive = text.upper().startswith("WITH RECURSIVE")
    rest = re.sub(r"^WITH( RECURSIVE)?\s", "", text, flags=re.I)
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(frames)}{', ' if rest != text else ' '}{rest}"


def _nested(text: str, name: str, put: Callable[[str], str]) -> str:
    """``{name(...)}`` with balanced parentheses, replaced."""
    while (at := text.find(f"{{{name}(")) >= 0:
        start, depth, i = at + len(name) + 2, 1, at + len(name) + 2
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        text = text[:at] + put(text[start : i - 1]) + text[i + 1 :]
    return text


def duckdb_sql(text: str) -> str:
    text = _nested(_nested(_full(text), "sha", lambda x: f"sha256({x})"), "epoch", lambda x: f"CAST(floor(epoch({x})) AS BIGINT)")
    for t in TABLES:
        text = text.replace(f"{{{t}}}", t)
    return text


def spark_sql(spark: SparkSession, sf_dir: str, text: str, **others: DataFrame) -> DataFrame:
    text = _nested(_nested(_full(text, _DEALT), "sha", lambda x: f"sha2({x}, 256)"), "epoch", lambda x: f"unix_seconds(CAST({x} AS TIMESTAMP))")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    if "{pieces}" in text:
        text = text.replace("{pieces}", str(pieces(used["events"])))
    return spark.sql(text, **used, **others)


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark_sql(spark, sf_dir, f"SELECT * FROM {name}")


def _register(name: str, f: Callable[[SparkSession, str], DataFrame]) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is registered twice")
    QUERIES[name] = f


def both(name: str, text: str, plain: str | None = None) -> None:
    """A statement that both engines run; where it is made for large tables, ``plain`` says the same by simpler means."""
    _register(name, lambda spark, sf_dir: spark_sql(spark, sf_dir, text))
    ORACLES[name] = duckdb_sql(plain or text)


def near_zones(side_e5: int, held: str = "zone_id", near: str = "TRUE", also: str = "") -> str:
    """Table expressions: pairs of places of zones (zy, zx) and fires (fy, fx) up to so many hundred-thousandths of a degree apart and ``near`` (pp), fires with each zones' place near theirs (fc), zones of a place in rows of HELD at most (zl).

    However many zones and fires share a place, it meets others once; NEAR then joins the zones' columns ``held``, ``also`` being further ones of theirs.  No side is
    broadcast: cells and places are far more rows than the tables' sizes promise.
    """
    cell = lambda x: f"CAST(floor({x} / {side_e5}.0) AS BIGINT)"
    return f"""nb AS (SELECT * FROM (VALUES (-1), (0), (1)) AS t(d)), zp AS (SELECT DISTINCT lat_e5 AS zy, lon_e5 AS zx FROM zones), fp AS (SELECT DISTINCT lat_e5 AS fy, lon_e5 AS fx FROM fires),
zr AS (SELECT zy, zx, {cell('zy')} + a.d AS r, {cell('zx')} + b.d AS c FROM zp CROSS JOIN nb a CROSS JOIN nb b), fr AS (SELECT fy, fx, {cell('fy')} AS r, {cell('fx')} AS c FROM fp),
pp AS (SELECT /*+ MERGE(zr, fr) */ zy, zx, fy, fx FROM zr JOIN fr ON fr.r = zr.r AND fr.c = zr.c WHERE abs(zy - fy) <= {side_e5} AND abs(zx - fx) <= {side_e5} AND {near}),
fc AS (SELECT /*+ MERGE(f, pp) */ f.*, pp.zy, pp.zx FROM fires f JOIN pp ON pp.fy = f.lat_e5 AND pp.fx = f.lon_e5),
zl AS (SELECT lat_e5, lon_e5, collect_list(struct({held})) AS held FROM (SELECT *{also}, (row_number() OVER (PARTITION BY lat_e5, lon_e5 ORDER BY zone_id) - 1) DIV {HELD} AS part FROM zones) zs GROUP BY lat_e5, lon_e5, part)"""


#: Fires and the zones near each (with the MERGE hint of f and w), for a statement that begins with ``near_zones``: each row meets lists of zones, so
#: pairs are made one by one where they are used, and no join sorts, buffers or reads them as rows.
NEAR = "fc f JOIN zl w ON w.lat_e5 = f.zy AND w.lon_e5 = f.zx LATERAL VIEW inline(w.held) z AS "


def query(name: str, sql: str | None = None) -> Callable:
    """A DataFrame function, with the SQL that has its result where SQL can say it."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _register(name, f)
        if sql:
            ORACLES[name] = duckdb_sql(sql)
        return f

    return put
