"""Queries of the parsing and place functions, and of what they are used for, with SQL that says the same another way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline import params as p
from emberline.functions import geo, parsing, text
from emberline.operators import alerts, joins, outline, tolerance, tracing
from emberline.plans import polygons
from emberline.plans.catalog import frame, query, spark_sql
from emberline.plans.relational import DAY, NOW
from emberline.plans.spatial import km, quanta


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _q(x: Column, scale: float) -> Column:
    return F.floor(x * scale + 0.5).cast("long")


# --- instants
@query("fn_07_iso_millis", "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN (epoch_us(ts) // 1000000) * 1000 + event_id % 1000 END AS ms FROM {events}")
def iso_millis(spark: SparkSession, sf_dir: str) -> DataFrame:
    iso = F.date_format(F.timestamp_millis(F.unix_seconds(F.col("ts").cast("timestamp")) * 1000 + F.col("event_id") % 1000), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return _read(spark, sf_dir, "events").select("event_id", parsing.iso_millis(F.concat(iso, F.when(F.col("event_id") % 4 == 0, "+00:00").otherwise("Z"))).alias("ms"))


@query("fn_21_lenient_instants", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 1704153600 WHEN 1 THEN 1704164645 WHEN 2 THEN 1704157445 END AS at_s FROM {part}")
def lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.array(F.lit("2024-01-02"), F.lit("2024-01-02T03:04:05Z"), F.lit("2024-01-02T03:04:05+02:00"), F.lit("next week"))
    return _read(spark, sf_dir, "part").select("p_partkey", F.unix_seconds(parsing.lenient_instant(F.element_at(forms, (F.col("p_partkey") % 4 + 1).cast("int")))).alias("at_s"))


@query("fn_19_cycles", "SELECT o_orderkey, CAST(epoch(date_trunc('day', o_orderdate)) AS BIGINT) + o_orderkey % 4 * 21600 AS cycle_s FROM {orders}")
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", parsing.cycle_seconds(F.date_format("o_orderdate", "yyyyMMdd"), F.col("o_orderkey") % 4 * 6).alias("cycle_s"))


@query("fn_20_epochs_without_zone", "SELECT event_id, epoch_us(ts) AS us FROM {events}")
def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", F.unix_micros(parsing.lenient_instant(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))).alias("us"))


@query("fn_12_iso_weeks", "SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS week FROM {orders}")
def iso_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", text.iso_week(F.col("o_orderdate").cast("date")).alias("week"))


_LOCAL = "(acq_s + 7200) % 86400 // 60"  # winter time in Sofia


@query("fn_16_quiet_events", f"SELECT event_id, CASE user_id % 3 WHEN 0 THEN {_LOCAL} >= 1320 OR {_LOCAL} < 420 WHEN 1 THEN {_LOCAL} BETWEEN 60 AND 299 ELSE FALSE END AS quiet FROM detections")
def quiet_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("user_id") % 3 + 1).cast("int"))
    return frame(spark, sf_dir, "detections").select("event_id", text.in_quiet_hours(F.timestamp_seconds("acq_s"), F.lit("Europe/Sofia"), pick("22:00", "01:00", "06:00"), pick("07:00", "05:00", "06:00")).alias("quiet"))


@query("fn_17_window_starts", "SELECT event_id, acq_s - (acq_s + 7200 - (user_id % 24) * 3600 - 1800) % 86400 AS start_s FROM detections")
def window_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hhmm = F.concat(F.lpad((F.col("user_id") % 24).cast("string"), 2, "0"), F.lit(":30"))
    return frame(spark, sf_dir, "detections").select("event_id", F.unix_seconds(text.window_start(F.timestamp_seconds("acq_s"), F.lit("Europe/Sofia"), hhmm)).alias("start_s"))


@query("fn_18_minutes", "SELECT event_id, acq_s % 86400 // 60 AS minute FROM detections")
def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "detections").select("event_id", text.minute_of_day(F.date_format(F.timestamp_seconds("acq_s"), "HH:mm")).cast("long").alias("minute"))


# --- texts
#: Latin letters of the tables' texts as the Cyrillic ones that stand at their place, so that every spelling comes up.
_FROM, _TO = "abcdefghijklmnopqrstuvwxyzéüñß", "".join(text.CYRILLIC)[:30]


@query("fn_22_transliterated", f"""
WITH c AS (SELECT doc_id, translate(lower(coalesce(text, '')), '{_FROM}', '{_TO}') AS t FROM {{documents}}), e AS (SELECT doc_id, regexp_replace(t, 'ия([^\\p{{L}}]|$)', 'ia\\1', 'g') AS t FROM c)
SELECT doc_id, md5({"".join("replace(" for _ in text.CYRILLIC)}t{"".join(f", '{k}', '{v}')" for k, v in text.CYRILLIC.items())}) AS digest FROM e""")
def transliterated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in Cyrillic letters, spelt in Latin ones."""
    cyrillic = F.translate(F.lower(F.coalesce("text", F.lit(""))), _FROM, _TO)
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(text.transliterate(cyrillic)).alias("digest"))


@query("fn_23_folded_names", "SELECT doc_id, md5(trim(regexp_replace(translate(lower(coalesce(text, '')), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^a-z0-9]+', ' ', 'g'), ' ')) AS digest FROM {documents}")
def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(text.fold_name(F.coalesce("text", F.lit("")))).alias("digest"))


#: Secrets that some texts are given, so that every rule has something to find.
_SECRETS = ["", " write to a.b+c@example.org now", " eyJhbGciOi.eyJzdWIi-x.sig_nature ", " Bearer abcDEF123456== and basic QWxhZGRpbjpvcGVu", " bot 123456789:AAbbCCddEEffGGhhIIjjKKllMMnnOOppQQr!"]


@query("fn_25_redacted", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') || [""" + ", ".join(f"'{x}'" for x in _SECRETS) + r"""][doc_id % 5 + 1] AS t FROM {documents})
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), 'eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+', '[jwt]', 'g'), '\b(bearer|basic)\s+[A-Za-z0-9+/=._~-]{8,}', '\1 [credential]', 'gi'), '\b\d{8,10}:[A-Za-z0-9_-]{35}\b', '[bot-token]', 'g')) AS digest FROM d""")
def redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, with a secret of each kind after some, redacted by all rules in their order."""
    secret = F.element_at(F.array(*map(F.lit, _SECRETS)), (F.col("doc_id") % 5 + 1).cast("int"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(text.redact(F.concat(F.coalesce("text", F.lit("")), secret))).alias("digest"))


@query("fn_33_label_values", r"""SELECT doc_id, md5(replace(replace(replace(coalesce(text, ''), '\', '\\'), '"', '\"'), chr(10), '\n')) AS digest FROM {documents}""")
def label_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.md5(text.label_escape(F.coalesce("text", F.lit("")))).alias("digest"))


#: Rules of a text lint: a name and a pattern; what an allowed span covers is not read.
LINT = [("promise", r"(?i)\b(guaranteed?|certain(ly)?)\b"), ("money", r"[$€]\s?\d+"), ("shout", r"!{2,}"), ("hour", r"\b\d{1,2}:\d\d\b")]
ALLOWED = r"\(c\)[^\n]*"


@query("fn_26_lint", r"SELECT doc_id, " + " + ".join(f"len(regexp_extract_all(regexp_replace(coalesce(text, ''), '{ALLOWED}', '', 'g'), '{pattern}'))" for _, pattern in LINT) + " AS violations, " + "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(regexp_replace(coalesce(text, ''), '{ALLOWED}', '', 'g'), '{pattern}') THEN '{name}' END" for name, pattern in LINT) + ") AS rules FROM {documents}")
def lint(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.regexp_replace(F.coalesce("text", F.lit("")), ALLOWED, "")
    found = {name: F.size(F.regexp_extract_all(own, F.lit(pattern), F.lit(0))) for name, pattern in LINT}
    total = sum(found.values(), F.lit(0))
    return _read(spark, sf_dir, "documents").select("doc_id", total.cast("long").alias("violations"), F.concat_ws(",", *[F.when(n > 0, name) for name, n in found.items()]).alias("rules"))


@query("fn_27_filled_templates", "SELECT zone_id, 'Fire ' || radius_m || ' m from zone ' || zone_id || ' {unknown}' AS line FROM zones")
def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "zones").select("zone_id", parsing.filled(F.lit("Fire {far} m from zone {zone} {unknown}"), {"far": F.col("radius_m").cast("string"), "zone": F.col("zone_id").cast("string")}).alias("line"))


#: Kinds as titles spell them: with other cases and separators, and some that no list has.
_KINDS = [*parsing.FIRE_KINDS, *parsing.HEAT_KINDS, *parsing.OTHER_KINDS, "dust", "Forest-Fire", "snow/ice", "Low_Temperature", "COASTAL  event"]
_COLOURS = ["Green", "yellow", "Orange", "RED", "purple"]


@query("fn_29_title_classes", f"""
WITH k AS (SELECT [{", ".join(f"'{k}'" for k in _KINDS)}] AS kinds, [{", ".join(f"'{c}'" for c in _COLOURS)}] AS colours), t AS (SELECT p_partkey, lower(colours[p_partkey % 5 + 1]) AS colour, lower(kinds[p_partkey // 5 % {len(_KINDS)} + 1]) AS kind FROM {{part}} CROSS JOIN k)
SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'unplaceable' WHEN colour = 'green' THEN 'not_relayed' WHEN colour = 'purple' THEN 'unplaceable'
  WHEN kind IN ('forest fire', 'forestfire', 'fire', 'forest-fire') THEN colour || ':forest-fire' WHEN kind IN ('high temperature', 'hightemperature', 'heat') THEN colour || ':high-temperature' WHEN kind = 'dust' THEN colour || ':?' ELSE 'not_relayed' END AS verdict FROM t""")
def title_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind under every colour, and titles that say something else."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    k = F.col("p_partkey")
    title = F.concat(F.lit(" "), pick(_COLOURS, k), F.lit("  "), pick(_KINDS, F.floor(k / 5)), F.when(k % 13 == 0, " alert for ").otherwise(" Warning issued for  "), F.col("p_name"))
    return _read(spark, sf_dir, "part").select("p_partkey", parsing.title_class(title).alias("verdict"))


@query("fn_30_path_segments", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '~2e' ELSE '' END || replace(replace(c_name, '#', '~23'), ' ', '~20') || '~2f~c3~a9' AS segment FROM {customer}")
def path_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.when(F.col("c_custkey") % 3 == 0, ".").otherwise(""), F.col("c_name"), F.lit("/é"))
    return _read(spark, sf_dir, "customer").select("c_custkey", parsing.path_segment(name).alias("segment"))


@query("fn_34_fragments", """
SELECT zone_id, CASE zone_id % 4 WHEN 0 THEN '24h' WHEN 1 THEN CAST(zone_id % 9 AS VARCHAR) || 'd' WHEN 2 THEN '' END AS "window", CASE WHEN zone_id % 3 > 0 THEN zone_id % 28 END AS oblast, zone_id % 5 = 0 AS has_family, CASE WHEN zone_id % 5 = 0 THEN 'a=b' END AS family FROM zones""")
def fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments with and without each member, repeated members, empty and bare ones, and values that hold a sign of equality."""
    k = F.col("zone_id")
    window = F.when(k % 4 == 0, "w=24h&w=7d").when(k % 4 == 1, F.concat(F.lit("w="), k % 9, F.lit("d"))).when(k % 4 == 2, "w=").otherwise("w")
    whole = F.concat(F.when(k % 2 == 0, "#").otherwise(""), F.concat_ws("&", window, F.lit("junk"), F.when(k % 3 > 0, F.concat(F.lit("o="), k % 28)), F.when(k % 5 == 0, F.lit("f=a=b"))))
    m = frame(spark, sf_dir, "zones").select("zone_id", parsing.fragment(whole)).toDF("zone_id", "m")
    return m.select("zone_id", F.col("m")["w"].alias("window"), F.col("m")["o"].cast("long").alias("oblast"), F.col("m")["f"].isNotNull().alias("has_family"), F.col("m")["f"].alias("family"))


@query("fn_35_typed_coordinates", "SELECT zone_id, CASE zone_id % 5 WHEN 4 THEN NULL WHEN 3 THEN (lat_e5 // 100000) * 100000 + 50000 ELSE lat_e5 // 100 * 100 END AS lat_e5, CASE zone_id % 5 WHEN 4 THEN NULL WHEN 3 THEN -(lon_e5 // 100000) * 100000 - 25000 ELSE lon_e5 // 100 * 100 END AS lon_e5 FROM zones")
def typed_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, k = frame(spark, sf_dir, "zones"), F.col("zone_id") % 5
    lat, lon = F.format_string("%.3f", F.floor(F.col("lat_e5") / 100) / 1000), F.format_string("%.3f", F.floor(F.col("lon_e5") / 100) / 1000)
    spelt = F.concat(F.floor(F.col("lat_e5") / 100000), F.lit("°30'N, "), F.floor(F.col("lon_e5") / 100000), F.lit("° 15′ 0\" W"))
    typed = F.when(k == 0, F.concat_ws(", ", lat, lon)).when(k == 1, F.translate(F.concat_ws(" ", lat, lon), ".", ",")).when(k == 2, F.concat_ws(";", lat, lon)).when(k == 3, spelt).otherwise("near 42, or so")
    at = z.select("zone_id", parsing.coordinates(typed).alias("at"))
    return at.select("zone_id", _q(F.col("at.lat"), 1e5).alias("lat_e5"), _q(F.col("at.lon"), 1e5).alias("lon_e5"))


#: First bytes of addresses, so that every reserved network comes up, with neighbours outside.
_HEADS = ["0.1", "1.1", "10.9", "100.64", "100.127", "100.128", "127.0", "169.253", "169.254", "172.15", "172.16", "172.31", "172.32", "192.0", "192.31", "192.52", "192.88", "192.168", "192.175", "198.17", "198.18", "198.19", "198.51", "203.0", "223.255", "224.0", "255.255", "8.8"]
_THIRD = [0, 1, 2, 48, 99, 100, 113, 193, 196, 200]
_V4_SQL = "(p IN (0, 10, 127) OR p >= 224 OR (p = 100 AND q BETWEEN 64 AND 127) OR (p = 169 AND q = 254) OR (p = 172 AND q BETWEEN 16 AND 31) OR (p = 192 AND (q = 168 OR (q = 0 AND r IN (0, 2)) OR (q = 88 AND r = 99) OR (q = 31 AND r = 196) OR (q = 52 AND r = 193) OR (q = 175 AND r = 48))) OR (p = 198 AND (q IN (18, 19) OR (q = 51 AND r = 100))) OR (p = 203 AND q = 0 AND r = 113))"
#: First two groups of IPv6 addresses, in and about the networks that are told apart.
_GROUPS = [(0x2001, 0), (0x2001, 0x1FF), (0x2001, 0x200), (0x2001, 0xDB8), (0x2001, 0xDB9), (0x2002, 1), (0x2003, 1), (0x3FFF, 0xFFF), (0x3FFF, 0x1000), (0x1FFF, 1), (0x4000, 1), (0xFE80, 1), (0xFD00, 1), (0x2A00, 0x1450)]


@query("fn_38_public_addresses", f"""
WITH h AS (SELECT [{", ".join(f"'{x}'" for x in _HEADS)}] AS heads, {_THIRD} AS thirds), a AS (SELECT event_id, string_split(heads[event_id % {len(_HEADS)} + 1], '.') AS pq, thirds[event_id // {len(_HEADS)} % {len(_THIRD)} + 1] AS r FROM {{events}} CROSS JOIN h), b AS (SELECT event_id, pq[1]::INT AS p, pq[2]::INT AS q, r FROM a)
SELECT event_id, event_id % 10 <> 0 AND NOT {_V4_SQL} AS public FROM b""")
def public_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in and about every reserved network of IPv4; a tenth has a leading zero, and so is none."""
    k = F.col("event_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    shown = F.concat_ws(".", pick(_HEADS, k), pick(_THIRD, F.floor(k / len(_HEADS))), (k % 256).cast("string"))
    return _read(spark, sf_dir, "events").select("event_id", parsing.is_public(F.when(k % 10 == 0, F.concat(F.lit("0"), shown)).otherwise(shown)).alias("public"))


@query("fn_38_public_v6", f"""
WITH h AS (SELECT {[a for a, _ in _GROUPS]} AS firsts, {[b for _, b in _GROUPS]} AS seconds, [{", ".join(f"'{x}'" for x in _HEADS)}] AS heads, {_THIRD} AS thirds),
a AS (SELECT event_id, event_id % 5 AS form, firsts[event_id // 5 % {len(_GROUPS)} + 1] AS g0, seconds[event_id // 5 % {len(_GROUPS)} + 1] AS g1, string_split(heads[event_id // 5 % {len(_HEADS)} + 1], '.') AS pq, thirds[event_id // 140 % {len(_THIRD)} + 1] AS r FROM {{events}} CROSS JOIN h), b AS (SELECT *, pq[1]::INT AS p, pq[2]::INT AS q FROM a)
SELECT event_id, CASE WHEN form IN (2, 3) THEN NOT {_V4_SQL} WHEN form = 4 THEN FALSE
  ELSE g0 BETWEEN 8192 AND 16383 AND NOT ((g0 = 8193 AND g1 < 512) OR (g0 = 8193 AND g1 = 3512) OR (g0 = 16383 AND g1 < 4096) OR g0 = 8194) END AS public FROM b""")
def public_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of IPv6: compressed, whole, with an embedded IPv4 address in two networks, and texts that are none."""
    k, n = F.col("event_id"), F.floor(F.col("event_id") / 5)
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    head = F.concat_ws(":", F.lower(F.hex(pick([a for a, _ in _GROUPS], n).cast("long"))), F.hex(pick([b for _, b in _GROUPS], n).cast("long")))
    v4 = F.concat_ws(".", pick(_HEADS, n), pick(_THIRD, F.floor(k / 140)), (k % 256).cast("string"))
    none = pick(["::", "::1", "2003::1::2", "2003:1:2:3:4:5:6", "2003::12345", "2003::1%en0", "2003::1.2.3", "2003:1:2:3:4:5:6:7::", "", "2003:1:2:3:4:5:6:7:8"], n)
    shown = F.when(k % 5 == 0, F.concat(head, F.lit("::1"))).when(k % 5 == 1, F.concat(head, F.lit(":0:0:a:b:c:D"))).when(k % 5 == 2, F.concat(F.lit("::ffff:"), v4)).when(k % 5 == 3, F.concat(F.lit("64:ff9b::"), v4)).otherwise(none)
    return _read(spark, sf_dir, "events").select("event_id", parsing.is_public(shown).alias("public"))


@query("fn_42_quantized_shares", """
WITH w AS (SELECT n_nationkey, unnest([n_nationkey * 7 % 11, n_nationkey * 3 % 5, 4, n_nationkey % 2]) AS w, unnest([0, 1, 2, 3]) AS i FROM {nation}), t AS (SELECT *, sum(w) OVER (PARTITION BY n_nationkey)::BIGINT AS total FROM w),
f AS (SELECT *, w * 10 // total AS low, w * 10 % total AS rest FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY rest DESC, i) AS place, 10 - sum(low) OVER (PARTITION BY n_nationkey) AS missing FROM f)
SELECT n_nationkey, array_to_string(list(low + CASE WHEN place <= missing THEN 1 ELSE 0 END ORDER BY i), ',') AS shares FROM r GROUP BY n_nationkey""")
def quantized_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey").cast("long")
    weights = F.array(k * 7 % 11, k * 3 % 5, F.lit(4).cast("long"), k % 2)
    return _read(spark, sf_dir, "nation").select("n_nationkey", F.array_join(parsing.quantized_shares(weights, 10).cast("array<string>"), ",").alias("shares"))


@query("fn_06_config_digests", """
WITH j AS (SELECT p_partkey, '{"brand":"' || p_brand || '","size":' || p_size || '}' AS j FROM {part}), b AS (SELECT p_partkey, list_transform(range(1, length(j) + 1), lambda i: CAST(ascii(j[i]) AS BIGINT)) AS codes FROM j)
SELECT p_partkey, lower(lpad(hex(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), codes), lambda h, c: (xor(h, c) * 16777619) & 4294967295)), 8, '0')) AS digest FROM b""")
def config_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", parsing.fnv_hex(F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size")))).alias("digest"))


# --- places
_HAVERSINE = "2 * 6371.0088 * asin(sqrt(least(1, pow(sin(radians(z2.lat - z.lat) / 2), 2) + cos(radians(z.lat)) * cos(radians(z2.lat)) * pow(sin(radians(z2.lon - z.lon) / 2), 2))))"
_BEARING = "degrees(atan2(sin(radians(z2.lon - z.lon)) * cos(radians(z2.lat)), cos(radians(z.lat)) * sin(radians(z2.lat)) - sin(radians(z.lat)) * cos(radians(z2.lat)) * cos(radians(z2.lon - z.lon))))"
_NEXT = "zones z JOIN zones z2 ON z2.zone_id = z.zone_id + 1"


def _next_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = frame(spark, sf_dir, "zones").select("zone_id", "lat", "lon")
    return z.join(z.select((F.col("zone_id") - 1).alias("zone_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")), "zone_id")


_FOUR = [F.col, "lat", "lon", "lat2", "lon2"]


@query("geo_08_haversine_metres", f"SELECT z.zone_id, CAST(floor({_HAVERSINE} * 1000 + 0.5) AS BIGINT) AS metres FROM {_NEXT}")
def haversine_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _next_zones(spark, sf_dir).select("zone_id", _q(geo.haversine_km(*map(F.col, _FOUR[1:])), 1000).alias("metres"))


@query("geo_12_bearings", f"SELECT z.zone_id, CAST(floor(((({_BEARING}) + 360) % 360) * 1000 + 0.5) AS BIGINT) AS bearing_e3 FROM {_NEXT}")
def bearings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _next_zones(spark, sf_dir).select("zone_id", _q(geo.bearing_degrees(*map(F.col, _FOUR[1:])), 1000).alias("bearing_e3"))


@query("geo_14_relative_positions", f"""
WITH d AS (SELECT z.zone_id, {_HAVERSINE} AS far, (({_BEARING}) + 360) % 360 AS b FROM {_NEXT})
SELECT zone_id, CASE WHEN far >= 10 THEN CAST(floor(far + 0.5) AS BIGINT) * 10 ELSE greatest(1, CAST(floor(far * 10 + 0.5) AS BIGINT)) END AS km_e1, ['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'][CAST(floor(b / 45 + 0.5) AS BIGINT) % 8 + 1] AS compass, far < 1 AS nearby FROM d""")
def relative_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = geo.relative_position(*map(F.col, _FOUR[1:]))
    return _next_zones(spark, sf_dir).select("zone_id", at.alias("p")).select("zone_id", "p.km_e1", "p.compass", "p.nearby")


@query("geo_06_canonical_degrees", "SELECT zone_id, CASE WHEN zone_id % 6 <> 0 THEN printf('%.5f', lat) END AS lat_text FROM zones")
def canonical_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("zone_id") % 6 == 0, F.concat(F.format_string("%.5f", "lat"), F.lit("e0"))).otherwise(F.concat(F.lit("+"), F.format_string("%.7f", F.col("lat") + 0.000001)))
    return frame(spark, sf_dir, "zones").select("zone_id", text.canonical_degrees(raw).alias("lat_text"))


@query("geo_20_widened_boxes", f"SELECT account_id, CAST(floor((min(lat) - 25 / {p.KM_LAT}) * 100000 + 0.5) AS BIGINT) AS south, CAST(floor((min(lon) - 25 / ({p.KM_LAT} * cos(radians(greatest(abs(min(lat)), abs(max(lat))))))) * 100000 + 0.5) AS BIGINT) AS west FROM zones GROUP BY account_id")
def widened_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = frame(spark, sf_dir, "zones").groupBy("account_id").agg(F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))
    wide = geo.widened(F.struct("west", "south", "east", "north"), F.lit(25.0))
    return b.select("account_id", wide.alias("b")).select("account_id", _q(F.col("b.south"), 1e5).alias("south"), _q(F.col("b.west"), 1e5).alias("west"))


@query("geo_25_coarsening_errors", f"SELECT zone_id, CAST(floor(sqrt(pow({p.KM_LAT} / 100, 2) + pow({p.KM_LAT} / 100 * cos(radians(lat)), 2)) / 2 * 1000 + 0.5) AS BIGINT) AS metres FROM zones")
def coarsening_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "zones").select("zone_id", _q(geo.coarse_error_km(F.col("lat")), 1000).alias("metres"))


@query("geo_31_tile_ranges", "WITH t AS (SELECT s_suppkey, s_suppkey % 5 AS z0, s_suppkey % 5 + 4 AS z1, 20 + s_suppkey % 8 AS w FROM {supplier}) SELECT s_suppkey, CAST(floor((w + 180) / 360.0 * 64) AS BIGINT) AS x0, CAST(floor((w + 3 + 180) / 360.0 * 64) AS BIGINT) AS x1 FROM t WHERE 6 BETWEEN z0 AND z1")
def tile_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers whose zooms hold zoom 6, with the columns of tiles under their boxes."""
    t = _read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 5).alias("z0"), (F.col("s_suppkey") % 5 + 4).alias("z1"), (20 + F.col("s_suppkey") % 8).alias("w"))
    column = lambda lon: F.floor((lon + 180) / 360 * 2**6).cast("long")
    return t.filter(F.lit(6).between(F.col("z0"), F.col("z1"))).select("s_suppkey", column(F.col("w")).alias("x0"), column(F.col("w") + 3).alias("x1"))


@query("geo_32_hilbert_ids", """
WITH RECURSIVE t AS (SELECT p_partkey, 6 AS z, p_partkey % 64 AS x, p_partkey * 7 % 64 AS y FROM {part}), h AS (
  SELECT p_partkey, 32::BIGINT AS s, x::BIGINT AS x, y::BIGINT AS y, 0::BIGINT AS d FROM t UNION ALL
  SELECT p_partkey, s // 2, CASE WHEN y & s > 0 THEN x WHEN x & s > 0 THEN s - 1 - y ELSE y END, CASE WHEN y & s > 0 THEN y WHEN x & s > 0 THEN s - 1 - x ELSE x END,
         d + s * s * xor(3 * CASE WHEN x & s > 0 THEN 1 ELSE 0 END, CASE WHEN y & s > 0 THEN 1 ELSE 0 END) FROM h WHERE s >= 1)
SELECT p_partkey, d + 1365 AS tile FROM h WHERE s = 0""")
def hilbert_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return _read(spark, sf_dir, "part").select("p_partkey", parsing.hilbert_id(F.lit(6), k % 64, k * 7 % 64).alias("tile"))


@query("geo_44_sun_elevation", f"""
WITH t AS (SELECT event_id, lat, lon, acq_s, acq_s / 86400.0::DOUBLE - 10957.5 AS n FROM detections), a AS (SELECT *, radians(357.528 + 0.9856003 * n) AS g, 280.46 + 0.9856474 * n AS q FROM t),
s AS (SELECT *, radians(q + 1.915 * sin(g) + 0.02 * sin(2 * g)) AS l, radians(23.439 - 0.0000004 * n) AS e FROM a),
h AS (SELECT *, radians(280.46061837 + 360.98564736629 * n + lon) - atan2(cos(e) * sin(l), cos(l)) AS h, asin(sin(e) * sin(l)) AS dec FROM s)
SELECT event_id, CAST(floor(degrees(asin(sin(radians(lat)) * sin(dec) + cos(radians(lat)) * cos(dec) * cos(h))) * 100 + 0.5) AS BIGINT) AS elevation_e2 FROM h""")
def sun_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "detections").select("event_id", _q(geo.sun_elevation(F.col("lat"), F.col("lon"), F.col("acq_s")), 100).alias("elevation_e2"))


@query("jn_09_disc_cells", f"""
WITH z AS (SELECT zone_id, lat, lon, CAST(radius_m AS DOUBLE) / 1000 / {p.KM_LAT} AS n FROM zones), e AS (SELECT *, n * {p.KM_LAT} / greatest({p.KM_LON} + {p.KM_LON_SLOPE} * (abs(lat) + n - {p.REF_LAT}), 1) AS e FROM z)
SELECT zone_id, (CAST(floor((lat + n) * 20) AS BIGINT) - CAST(floor((lat - n) * 20) AS BIGINT) + 3) * (CAST(floor((lon + e) * 20) AS BIGINT) - CAST(floor((lon - e) * 20) AS BIGINT) + 3) AS cells FROM e""")
def disc_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = geo.cells_within(F.col("lat"), F.col("lon"), F.col("radius_m").cast("double") / 1000)
    return frame(spark, sf_dir, "zones").select("zone_id", F.size(F.array_distinct(cells)).cast("long").alias("cells"))


@query("srt_15_nearest_place", f"SELECT f.fire_id, arg_min(z.zone_id, ({quanta(km('f', 'z'))}) * 10000000::HUGEINT + z.zone_id) AS zone_id FROM fires f JOIN zones z ON abs(z.lat - f.lat) < 0.3 AND abs(z.lon - f.lon) < 0.4 AND {quanta(km('f', 'z'))} <= {quanta('20.0')} GROUP BY f.fire_id")
def nearest_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = joins.nearest(frame(spark, sf_dir, "fires").select("fire_id", "lat", "lon"), frame(spark, sf_dir, "zones").select("zone_id", "lat", "lon"), "zone_id", 20.0, 5)
    return found.select("fire_id", F.col("r_key").alias("zone_id"))


@query("set_08_canonical_sources", "SELECT fire_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM members WHERE fire_id % 9 <> 0 GROUP BY fire_id UNION ALL SELECT DISTINCT fire_id, NULL FROM members WHERE fire_id % 9 = 0")
def canonical_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = frame(spark, sf_dir, "members").groupBy("fire_id").agg(F.collect_list(F.when(F.col("fire_id") % 9 != 0, F.col("source"))).alias("ids"))
    return m.select("fire_id", F.array_join(text.source_ids(F.col("ids")), ",").alias("sources"))


def near_misses(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows that one side lacks and the other has instead, a little off in time and place; several may want the same."""
    d = frame(spark, sf_dir, "detections").select("event_id", "uid", "acq_s", "lat_e5", "lon_e5")
    missing = d.filter("event_id % 4 < 2").withColumns({"acq_s": F.col("acq_s") + F.col("event_id") % 5 * 60, "lat_e5": F.col("lat_e5") + F.col("event_id") % 3 * 100})
    return missing.drop("event_id"), d.filter("event_id % 4 > 0").drop("event_id")


@query("jn_30_tolerance_pairs")
def tolerance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tolerance.tolerance_pairs(*near_misses(spark, sf_dir), 43200, 1000)


# --- rows of arrays, and arrays of rows
@query("add_40_grid_points", "WITH g AS (SELECT s_suppkey, unnest(range(12)) AS i FROM {supplier}) SELECT s_suppkey, 2200000 + i % 4 * 25000 AS lon_e5, 4300000 - i // 4 * 25000 AS lat_e5, (s_suppkey * 31 + i * 17) % 40 AS speed FROM g")
def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    g = _read(spark, sf_dir, "supplier").select("s_suppkey", F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: (k * 31 + i * 17) % 40).alias("speed"))
    at = g.select("s_suppkey", F.posexplode("speed").alias("i", "speed"))
    return at.select("s_suppkey", (2200000 + F.col("i") % 4 * 25000).cast("long").alias("lon_e5"), (4300000 - F.floor(F.col("i") / 4) * 25000).cast("long").alias("lat_e5"), "speed")


@query("add_41_column_arrays", "SELECT user_id, event_id, source FROM detections")
def column_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A body of parallel columns with its sources as places in a dictionary, back to rows."""
    d = frame(spark, sf_dir, "detections")
    body = d.groupBy("user_id").agg(F.collect_list(F.struct("event_id", "source")).alias("r")).withColumn("dictionary", F.array_sort(F.array_distinct("r.source")))
    body = body.select("user_id", "dictionary", F.col("r.event_id").alias("event_id"), F.transform("r.source", lambda s: F.array_position("dictionary", s)).alias("source"))
    rows = body.select("user_id", "dictionary", F.explode(F.arrays_zip("event_id", "source")).alias("z"))
    return rows.select("user_id", "z.event_id", F.element_at("dictionary", F.col("z.source").cast("int")).alias("source"))


@query("add_42_footprints", f"SELECT event_id, CAST(floor((lon - scan_km / 2 / {p.KM_LON}) * 1000000 + 0.5) AS BIGINT) AS west_e6, CAST(floor((lat + track_km / 2 / {p.KM_LAT}) * 1000000 + 0.5) AS BIGINT) AS north_e6, 5 AS vertices FROM members")
def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = frame(spark, sf_dir, "members").groupBy("fire_id").agg(F.collect_list(F.struct("event_id", "lat", "lon", "scan_km", "track_km")).alias("d"))
    d = groups.select(F.explode("d").alias("d")).select("d.*")
    east, north = F.col("scan_km") / 2 / p.KM_LON, F.col("track_km") / 2 / p.KM_LAT
    ring = F.array(*[F.struct((F.col("lon") + a * east).alias("x"), (F.col("lat") + b * north).alias("y")) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))])
    return d.select("event_id", ring.alias("r")).select("event_id", _q(F.array_min("r.x"), 1e6).alias("west_e6"), _q(F.array_max("r.y"), 1e6).alias("north_e6"), F.size("r").cast("long").alias("vertices"))


@query("udf_25_account_documents", "SELECT account_id, count(*) AS zones, sum(n)::BIGINT AS notices FROM (SELECT z.account_id, z.zone_id, count(t.transition_id) AS n FROM zones z LEFT JOIN transitions t ON t.public_id = z.zone_id GROUP BY 1, 2) x GROUP BY account_id")
def account_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document for each account, of zones and their notices in order; the query counts what is in it."""
    t = frame(spark, sf_dir, "transitions").groupBy(F.col("public_id").alias("zone_id")).agg(F.array_sort(F.collect_list(F.struct("at_s", "transition_id", "to_status"))).alias("notices"))
    zones = frame(spark, sf_dir, "zones").select("account_id", "zone_id", "radius_m").join(t, "zone_id", "left")
    zone = F.struct("zone_id", "radius_m", F.coalesce("notices", F.array().cast("array<struct<at_s: long, transition_id: long, to_status: string>>")).alias("notices"))
    docs = zones.groupBy("account_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(zone)).alias("zones"))).alias("document"))
    read = docs.select("account_id", F.from_json("document", "zones array<struct<zone_id: long, notices: array<struct<at_s: long>>>>").alias("d"))
    return read.select("account_id", F.size("d.zones").cast("long").alias("zones"), F.aggregate("d.zones", F.lit(0).cast("long"), lambda a, z: a + F.size(z["notices"])).alias("notices"))


_WEEK = 804556800  # a Monday


@query("agg_33_weekly_report", f"""
WITH t AS (SELECT *, lead(at_s) OVER w AS again_s, lag(at_s) OVER w AS before_s, lag(to_status) OVER w AS was FROM transitions WINDOW w AS (PARTITION BY public_id ORDER BY at_s, transition_id)), x AS (SELECT * FROM t WHERE at_s >= {_WEEK} AND at_s < {_WEEK + 7 * DAY})
SELECT 'fer' AS metric, count(*) FILTER (WHERE again_s - at_s <= 259200) AS numerator, count(*) AS denominator FROM x WHERE to_status = 'F' UNION ALL
SELECT 'flr', count(DISTINCT public_id) FILTER (WHERE was <> to_status AND at_s - before_s <= 172800), count(DISTINCT public_id) FROM x UNION ALL
SELECT 'dar', count(*) FILTER (WHERE was = to_status AND at_s - before_s <= 21600), count(*) FROM x""")
def weekly_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ISO week's metrics of closures, flapping and repeats, each with its own denominator."""
    w = Window.partitionBy("public_id").orderBy("at_s", "transition_id")
    t = frame(spark, sf_dir, "transitions").withColumns({"again_s": F.lead("at_s").over(w), "before_s": F.lag("at_s").over(w), "was": F.lag("to_status").over(w)})
    x = t.filter((F.col("at_s") >= _WEEK) & (F.col("at_s") < _WEEK + 7 * DAY))
    since = F.col("at_s") - F.col("before_s")
    row = lambda name, df, top, bottom: df.agg(F.lit(name).alias("metric"), top.alias("numerator"), bottom.alias("denominator"))
    fer = row("fer", x.filter("to_status = 'F'"), F.count_if(F.col("again_s") - F.col("at_s") <= 259200), F.count("*"))
    flr = row("flr", x, F.count_distinct(F.when((F.col("was") != F.col("to_status")) & (since <= 172800), F.col("public_id"))), F.count_distinct("public_id"))
    return fer.unionByName(flr).unionByName(row("dar", x, F.count_if((F.col("was") == F.col("to_status")) & (since <= 21600)), F.count("*")))


# --- alerts
_AT = NOW - 9 * DAY
_PAIRS = f"""
SELECT z.zone_id, z.account_id, z.min_score, z.created_s, f.fire_id, f.score, f.n, f.started_s, f.last_s, f.invalidated, m.non_geo, m.night_high, f.fire_id % 23 = 0 AS quarantined,
       CASE WHEN (z.zone_id + f.fire_id) % 5 < 2 THEN {_AT} - (z.zone_id * 31 + f.fire_id * 7) % 40000 END AS notified_s, {_AT} - z.zone_id * 577 % 30000 AS zone_notified_s, f.fire_id % 4 AS step, z.zone_id % 3 AS last_step,
       ({_AT} + 7200) % 86400 NOT BETWEEN 25200 AND 79199 AND z.zone_id % 2 = 0 AS quiet, CAST(abs(z.lat_e5 - f.lat_e5) + abs(z.lon_e5 - f.lon_e5) AS BIGINT) AS metres
FROM {{meet}} JOIN (SELECT fire_id, count(*) FILTER (WHERE source <> 'geo_msg') AS non_geo, count(*) FILTER (WHERE day_night = 'N' AND confidence = 'high') AS night_high FROM members GROUP BY fire_id) m ON m.fire_id = f.fire_id"""
_MEET = "zones z JOIN fires f ON abs(z.lat_e5 - f.lat_e5) < 20000 AND abs(z.lon_e5 - f.lon_e5) < 20000"
_RULES = [
    ("suppress:quarantined", "quarantined"), ("suppress:invalidated", "invalidated"), ("suppress:geo_only", "non_geo = 0"), ("suppress:insufficient_persistence", "n < 2 AND night_high < 1"), ("suppress:below_zone_threshold", "score < min_score"),
    ("suppress:pre_existing", "notified_s IS NULL AND started_s < created_s"), ("suppress:no_higher_rung", "notified_s IS NOT NULL AND step <= last_step"), ("defer:digest_floor", f"{_AT} - notified_s < 1800"), ("defer:suppression_window", f"{_AT} - notified_s < 21600"),
    ("defer:zone_suppression", f"notified_s IS NOT NULL AND {_AT} - zone_notified_s < 21600"), ("defer:stale_trigger", f"notified_s IS NULL AND {_AT} - last_s > 1800"), ("defer:quiet_hours", "quiet AND NOT (notified_s IS NULL OR min_score >= 0.45) AND score < 0.75"),
]
_CASES = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in _RULES) + " ELSE 'send:clear' END"
_TRACE = "CASE " + " ".join(f"WHEN {c} THEN '" + " ".join(["-" + m.split(":")[1] for m, _ in _RULES[:i]] + ["+" + n.split(":")[1]]) + "'" for i, (n, c) in enumerate(_RULES)) + " ELSE '" + " ".join("-" + m.split(":")[1] for m, _ in _RULES) + "' END"


def _pairs(spark: SparkSession, sf_dir: str, firsts: DataFrame | None = None) -> DataFrame:
    """Pairs of near zones and fires; with ``firsts`` (fire_id, firsts) each fire brings its own, so that pairs needn't be joined with them."""
    from emberline.plans.catalog import NEAR, near_zones

    pair, counts = _PAIRS.split("FROM {meet} JOIN ")
    counts = counts.rsplit(" m ON", 1)[0]  # (counts of members), joined with fires before these are paired
    pair = pair.replace("SELECT z.zone_id", "SELECT /*+ MERGE(f, w) */ z.zone_id", 1).replace("z.lat_e5", "f.zy").replace("z.lon_e5", "f.zx").replace("m.non_geo, m.night_high", "f.non_geo, f.night_high").replace("AS metres", "AS metres, f.firsts" if firsts is not None else "AS metres")
    with_firsts = (", w.firsts", "LEFT JOIN {firsts} w ON w.fire_id = fc.fire_id") if firsts is not None else ("", "")
    held = "zone_id, account_id, min_score, created_s"
    text = f"""WITH {near_zones(20000, held, 'abs(zy - fy) < 20000 AND abs(zx - fx) < 20000')}, fm AS (SELECT fc.*, m.non_geo, m.night_high{with_firsts[0]} FROM fc JOIN {counts} m ON m.fire_id = fc.fire_id {with_firsts[1]})
{pair} FROM {NEAR.replace('fc f', 'fm f')}{held}"""
    return spark_sql(spark, sf_dir, text, **({"firsts": firsts} if firsts is not None else {}))


@query("udf_21_decision_traces", f"WITH x AS ({_PAIRS.format(meet=_MEET)}) SELECT zone_id, fire_id, {_CASES} AS decision, {_TRACE} AS trace FROM x")
def decision_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.decided(_pairs(spark, sf_dir), _AT).select("zone_id", "fire_id", "decision", "trace")


@query("str_15_sending_zones", f"WITH x AS ({_PAIRS.format(meet=_MEET)}), d AS (SELECT *, {_CASES} AS decision FROM x) SELECT zone_id, fire_id, decision, decision LIKE 'send%' AND row_number() OVER (PARTITION BY account_id, fire_id ORDER BY CASE WHEN decision LIKE 'send%' THEN 0 ELSE 1 END, metres, zone_id) = 1 AS sends FROM d")
def sending_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    firsts = alerts.first_senders(alerts.decided(_pairs(spark, sf_dir), _AT))
    return alerts.one_zone_an_account(alerts.decided(_pairs(spark, sf_dir, firsts), _AT)).select("zone_id", "fire_id", "decision", "sends")


# --- outlines over time
@query("win_04_outline_series", """
WITH s AS (SELECT *, CASE WHEN acq_s - lag(acq_s) OVER w <= 900 THEN 0 ELSE 1 END AS fresh FROM members WHERE source <> 'geo_msg' WINDOW w AS (PARTITION BY fire_id ORDER BY acq_s, uid)), k AS (SELECT *, sum(fresh) OVER (PARTITION BY fire_id ORDER BY acq_s, uid ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM s),
ends AS (SELECT fire_id, session, max(acq_s) AS at_s FROM k GROUP BY 1, 2), c AS (SELECT e.fire_id, e.at_s, unnest(range((k.lat_e5 - 300) // 200, (k.lat_e5 + 300) // 200 + 1)) AS r, k.lon_e5 FROM ends e JOIN k ON k.fire_id = e.fire_id AND k.acq_s <= e.at_s),
g0 AS (SELECT fire_id, at_s, r, unnest(range((lon_e5 - 300) // 200, (lon_e5 + 300) // 200 + 1)) AS c FROM c), g AS (SELECT DISTINCT * FROM g0), nb AS (SELECT * FROM (VALUES (-1), (0), (1)) AS t(d)), dil AS (SELECT DISTINCT fire_id, at_s, r + a.d AS r, c + b.d AS c FROM g CROSS JOIN nb a CROSS JOIN nb b),
ero AS (SELECT fire_id, at_s, r + a.d AS r, c + b.d AS c FROM dil CROSS JOIN nb a CROSS JOIN nb b GROUP BY 1, 2, 3, 4 HAVING count(*) = 9)
SELECT fire_id, at_s, count(*) AS cells FROM ero GROUP BY 1, 2""")
def outline_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = frame(spark, sf_dir, "members").filter("source != 'geo_msg'").select("fire_id", "uid", "acq_s", "lat_e5", "lon_e5")
    return outline.series(m, "fire_id", points=None).select("fire_id", "at_s", "cells")


_CELLS = """
WITH d AS (SELECT DISTINCT fire_id, lat_e5, lon_e5 FROM members), rr AS (SELECT *, unnest(range((lat_e5 - 300) // 200, (lat_e5 + 300) // 200 + 1)) AS r FROM d), g AS (SELECT fire_id, r, unnest(range((lon_e5 - 300) // 200, (lon_e5 + 300) // 200 + 1)) AS c FROM rr), f AS (SELECT DISTINCT * FROM g),
nb AS (SELECT * FROM (VALUES (-1), (0), (1)) AS t(d)), dil AS (SELECT DISTINCT fire_id, r + a.d AS r, c + b.d AS c FROM f CROSS JOIN nb a CROSS JOIN nb b), ero AS (SELECT fire_id, r + a.d AS r, c + b.d AS c FROM dil CROSS JOIN nb a CROSS JOIN nb b GROUP BY 1, 2, 3 HAVING count(*) = 9)"""


@query("udf_04_outline_rings", _CELLS + """, n AS (SELECT e.fire_id, count(*) AS cells FROM ero e GROUP BY 1), s AS (SELECT e.fire_id, count(*) AS shared FROM ero e JOIN ero x ON x.fire_id = e.fire_id AND ((x.r = e.r + 1 AND x.c = e.c) OR (x.r = e.r AND x.c = e.c + 1)) GROUP BY 1)
SELECT n.fire_id, 2 * cells AS doubled_area, 4 * cells - 2 * coalesce(shared, 0) AS border FROM n LEFT JOIN s ON s.fire_id = n.fire_id""")
def outline_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traced rings of all outlines: their areas and borders must be those of the cells (none of these has a hole)."""
    keys, places = outline.shapes(frame(spark, sf_dir, "members"), "fire_id")
    rings = tracing.outline_rings(outline.closed(outline.filled(places, "shape"), "shape"), "shape", 0.7)
    return keys.join(rings.groupBy("shape").agg(F.sum("doubled_area").alias("doubled_area"), F.sum("border").alias("border")), "shape").drop("shape")


@query("udf_02_simplified_rings", _CELLS + " SELECT fire_id, 2 * count(*) AS doubled_area FROM ero GROUP BY 1")
def simplified_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings with no tolerance keep their corners alone, and so their areas."""
    keys, places = outline.shapes(frame(spark, sf_dir, "members"), "fire_id")
    v = tracing.outline_rings(outline.closed(outline.filled(places, "shape"), "shape"), "shape", 0.0).withColumn("s", F.arrays_zip("vertices", F.concat(F.slice("vertices", 2, F.size("vertices")), F.slice("vertices", 1, 1)).alias("after")))
    area = F.aggregate("s", F.lit(0).cast("long"), lambda a, e: a + e["vertices"]["x"] * e["after"]["y"] - e["after"]["x"] * e["vertices"]["y"])
    return keys.join(v.groupBy("shape").agg(F.sum(area).alias("doubled_area")), "shape").drop("shape")


@query("udf_08_assembled_rings", "SELECT zone_id, CASE WHEN zone_id % 7 = 0 THEN 0 ELSE 1 END AS rings, CASE WHEN zone_id % 7 = 0 THEN 1 ELSE 0 END AS unclosed, CASE WHEN zone_id % 7 = 0 THEN 0 ELSE 7 END AS vertices FROM zones")
def assembled_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each perimeter in three pieces, out of order and one backwards; a seventh of them lack one."""
    r = polygons.perimeters(spark, sf_dir).select(F.col("key").alias("zone_id"), F.col("rings")[0].alias("v"))
    piece = lambda place, way: F.struct(F.lit(place).alias("place"), way.alias("way"))
    pieces = F.array(piece(2, F.slice("v", 1, 3)), piece(0, F.reverse(F.slice("v", 3, 3))), piece(1, F.concat(F.slice("v", 5, 3), F.slice("v", 1, 1))))
    ways = r.select("zone_id", F.explode(pieces).alias("p")).select("zone_id", "p.*").filter("zone_id % 7 != 0 OR place != 1")
    got = tracing.rings_of_ways(ways, "zone_id")
    return got.select("zone_id", F.size("rings").alias("rings"), "unclosed", F.aggregate("rings", F.lit(0), lambda a, ring: a + F.size(ring)).alias("vertices"))
