"""Files of the domain, written from the tables into the shared folder and read back by the readers; and what the writers make.

The SQL beside each says from the tables themselves what must come back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import text
from emberline.operators.graph import shared_folder
from emberline.plans.catalog import frame, query
from emberline.sources import archive, documents, readers, sinks


def _landed(rows: DataFrame, name: str, kind: str, **options) -> str:
    path = shared_folder(rows.sparkSession, name)
    rows.write.options(**options).format(kind).save(path)
    return path


def _whole(bodies: DataFrame, name: str) -> str:
    """Each body as a file of its own: one row a partition of the writer, by number."""
    path = shared_folder(bodies.sparkSession, name)
    bodies.write.partitionBy("file").text(path)
    return path


_ISO = "strftime(make_timestamp(acq_s * 1000000), '%Y-%m-%dT%H:%M:00Z')"
_UID = f"sha256('viirs_snpp|' || {_ISO} || '|' || printf('%.5f', lat) || '|' || printf('%.5f', lon))"


@query("src_01_active_fire_files", f"SELECT {_UID} AS uid, lat_e5, lon_e5, acq_s, confidence, day_night, CAST(floor(frp * 100 + 0.5) AS BIGINT) AS frp_e2 FROM detections WHERE event_id % 17 <> 0 AND event_id % 19 <> 0")
def active_fire_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of active fires, some rows without a readable confidence or place: those are rejected, each alone."""
    d, at = frame(spark, sf_dir, "detections"), F.timestamp_seconds("acq_s")
    five = lambda c: F.format_string("%.5f", c)
    confidence = F.when(F.col("event_id") % 17 == 0, "?").when(F.col("confidence") == "low", "l").when(F.col("confidence") == "nominal", "n").otherwise("h")
    rows = d.select(
        F.when(F.col("event_id") % 19 == 0, "4x").otherwise(five("lat")).alias("latitude"), five("lon").alias("longitude"), F.col("brightness_k").alias("bright_ti4"), F.col("scan_km").alias("scan"), F.col("track_km").alias("track"),
        F.date_format(at, "yyyy-MM-dd").alias("acq_date"), F.date_format(at, "HHmm").cast("int").cast("string").alias("acq_time"), F.lit("N").alias("satellite"), confidence.alias("confidence"), F.lit("2.0NRT").alias("version"), F.col("frp"), F.col("day_night").alias("daynight"))
    read = readers.active_fire_csv(spark, _landed(rows, "active-fires", "csv", header=True)).withColumn("available_s", F.lit(0).cast("long"))
    good, _ = readers.parsed(read, "viirs_snpp")
    return good.select("uid", "lat_e5", "lon_e5", "acq_s", "confidence", "day_night", F.floor(F.col("frp") * 100 + 0.5).cast("long").alias("frp_e2"))


@query("src_02_rejected_rows", "SELECT count(*) AS rejected FROM {part} WHERE p_partkey % 10 = 0")
def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted cells, commas and spaces within them, and times of one to four digits; a tenth has an hour of 25."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    time = F.when(F.col("p_partkey") % 10 == 0, "2500").otherwise((F.col("p_partkey") % 24 * 100 + F.col("p_partkey") % 60).cast("string"))
    rows = p.select(F.lit(" 42.5").alias("latitude"), F.lit("23.25").alias("longitude"), F.lit("300").alias("bright_ti4"), F.lit("0.4").alias("scan"), F.lit("0.4").alias("track"), F.lit("2024-01-05").alias("acq_date"), time.alias("acq_time"), F.lit('N, "20"').alias("satellite"), F.lit("n").alias("confidence"), F.lit("2").alias("version"), F.lit("5").alias("frp"), F.lit("D").alias("daynight"))
    read = readers.active_fire_csv(spark, _landed(rows, "quoted", "csv", header=True, escape='"', ignoreLeadingWhiteSpace=False)).withColumn("available_s", F.lit(0).cast("long"))
    return readers.parsed(read, "viirs_snpp")[1].agg(F.count("*").alias("rejected"))


@query("src_09_availability_files", "SELECT lower(n_name) AS product, CASE WHEN n_nationkey % 5 <> 0 THEN strftime(DATE '2020-01-01' + n_nationkey::INTEGER, '%Y-%m-%d') END AS first_day, strftime(DATE '2024-01-01' + n_nationkey::INTEGER, '%Y-%m-%d') AS last_day FROM {nation}")
def availability_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    day = lambda d: F.date_format(F.date_add(F.lit(d).cast("date"), F.col("n_nationkey")), "yyyy-MM-dd")
    rows = n.select(F.col("n_name").alias("data_id"), F.when(F.col("n_nationkey") % 5 == 0, "soon").otherwise(day("2020-01-01")).alias("min_date"), day("2024-01-01").alias("max_date"))
    got = readers.availability_csv(spark, _landed(rows, "availability", "csv", header=True))
    return got.select("product", F.col("first_day").cast("string").alias("first_day"), F.col("last_day").cast("string").alias("last_day"))


@query("src_27_index_entries", "SELECT p_type AS param, min(p_partkey * 100) AS \"offset\", min(p_partkey) % 97 AS length FROM {part} WHERE p_partkey % 3 = 0 AND p_size > 25 GROUP BY p_type")
def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON-lines index in one file, so that the first entry of a parameter is the one that stands first."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    line = F.when(F.col("p_partkey") % 11 == 0, "{broken").otherwise("")
    entry = F.to_json(F.struct(F.when(F.col("p_partkey") % 3 == 0, "sfc").otherwise("pl").alias("levtype"), F.when(F.col("p_size") > 25, "6").otherwise("12").alias("step"), F.col("p_type").alias("param"), (F.col("p_partkey") * 100).alias("_offset"), (F.col("p_partkey") % 97).alias("_length")))
    rows = p.select("p_partkey", F.explode(F.array(entry, line)).alias("value")).filter("value != ''").coalesce(1).sortWithinPartitions("p_partkey").select("value")
    names = [r[0] for r in p.select("p_type").distinct().collect()]  # a short list of names
    return readers.index_lines(spark, _landed(rows, "index", "text"), "6", names)


@query("src_29_feed_entries", "SELECT 'urn:' || o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN 'Order & <' || o_orderstatus || '>' END AS title, o_orderkey % 7 <> 0 AS usable FROM {orders} WHERE o_custkey % 20 <> 3")
def feed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atom feeds, one a customer: some bodies are no feed, some entries have no title."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    title = F.concat(F.lit("<title>"), text.xml_escape(F.concat(F.lit("Order & <"), "o_orderstatus", F.lit(">"))), F.lit("</title>"))
    entry = F.concat(F.lit("<entry><id>urn:"), "o_orderkey", F.lit("</id>"), F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(title), F.lit("<updated>2024-01-02T03:04:05Z</updated></entry>"))
    feeds = o.groupBy("o_custkey").agg(F.concat_ws("", F.collect_list(entry)).alias("entries"))  # the orders of one customer
    body = F.when(F.col("o_custkey") % 20 == 3, F.concat(F.lit("<html>"), "entries", F.lit("</html>"))).otherwise(F.concat(F.lit('<?xml version="1.0"?><feed>'), "entries", F.lit("</feed>")))
    return documents.feed_entries(feeds.select(body.alias("body"))).select("id", "title", "usable")


@query("src_30_alert_areas", "SELECT 'cap-' || s_suppkey AS identifier, l AS language, CASE WHEN s_suppkey % 4 = 0 THEN 'Severe' ELSE 'Minor' END AS severity, 'area ' || a AS area FROM {supplier} CROSS JOIN (VALUES ('en'), ('de')) t(l) CROSS JOIN (VALUES (1), (2)) u(a) WHERE s_suppkey % 10 <> 1")
def alert_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    info = lambda lang: F.concat(F.lit(f"<info><language>{lang}</language><event>wildfire</event><severity>"), F.when(F.col("s_suppkey") % 4 == 0, "Severe").otherwise("Minor"), F.lit("</severity><onset>2024-01-02T00:00:00Z</onset><area><areaDesc>area 1</areaDesc></area><area><areaDesc>area 2</areaDesc></area></info>"))
    name = F.when(F.col("s_suppkey") % 10 == 1, "").otherwise(F.concat(F.lit("<identifier>cap-"), "s_suppkey", F.lit("</identifier>")))
    return documents.alert_areas(s.select(F.concat(F.lit("<alert>"), name, info("en"), info("de"), F.lit("</alert>")).alias("body"))).select("identifier", "language", "severity", "area")


@query("src_31_activation_list", "SELECT 'EMSR' || c_custkey AS code, c_mktsegment AS category, (c_custkey % 180)::DOUBLE AS lon, (c_custkey % 90)::DOUBLE AS lat FROM {customer}")
def activation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a list of activations: one JSON body for each nation."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    item = F.struct(F.concat(F.lit("EMSR"), "c_custkey").alias("code"), F.col("c_mktsegment").alias("category"), F.concat(F.lit("POINT ("), F.col("c_custkey") % 180, F.lit(" "), F.col("c_custkey") % 90, F.lit(")")).alias("centroid"))
    pages = c.groupBy("c_nationkey", (F.col("c_custkey") % 100).alias("page")).agg(F.to_json(F.struct(F.collect_list(item).alias("results"))).alias("body"))
    return documents.activations(pages.select("body")).select("code", "category", "lon", "lat")


@query("src_36_perimeter_features", "SELECT s_suppkey::VARCHAR AS id, CASE WHEN s_suppkey % 5 = 0 THEN 'no_polygon' WHEN s_suppkey % 7 = 0 THEN 'no_area' WHEN s_suppkey % 3 = 0 THEN 'bad_date' END AS reject FROM {supplier}")
def perimeter_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    k = F.col("s_suppkey")
    ring = F.array(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(2.0)), F.array(F.lit(2.0), F.lit(3.0)), F.array(F.lit(1.0), F.lit(2.0))))
    props = F.struct(k.cast("string").alias("id"), F.when(k % 7 == 0, -1.0).otherwise(5.0).alias("area_ha"), F.lit("2024-02-01T00:00:00Z").alias("firedate"), F.when(k % 3 == 0, "2024-01-01T00:00:00Z").otherwise("2024-03-01T00:00:00Z").alias("lastupdate"))
    feature = F.to_json(F.struct(props.alias("properties"), F.struct(F.when(k % 5 == 0, "Point").otherwise("Polygon").alias("type"), ring.alias("coordinates")).alias("geometry")))
    return readers.perimeters(s.select(feature.alias("feature"))).select("id", "reject")


@query("src_43_replayed_detections", "SELECT uid, source, CASE WHEN event_id % 4 = 0 THEN 'own' ELSE 'file' END AS arrived FROM detections")
def replayed_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poll files of a scenario: detections without an arrival of their own inherit the file's."""
    d = frame(spark, sf_dir, "detections")
    item = F.struct(F.col("uid").alias("detectionUid"), "source", F.when(F.col("event_id") % 4 == 0, "own").alias("availableAt"))
    polls = d.groupBy(F.floor(F.col("acq_s") / 3600).alias("hour"), F.col("user_id")).agg(F.to_json(F.struct(F.lit("file").alias("availableAt"), F.collect_list(item).alias("detections"))).alias("value"))
    path = _landed(polls.select("value"), "polls", "text")
    return readers.replay_batches(spark, path, lines=True).select(F.col("detectionUid").alias("uid"), "source", F.col("available_at").alias("arrived"))


@query("add_45_place_names", "SELECT c_custkey AS place_id, c_name AS name, c_custkey % 90 AS lat, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey * 3 END AS population FROM {customer}")
def place_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    cells = [F.col("c_custkey"), F.col("c_name"), F.lit("a"), F.lit('un"quoted'), F.col("c_custkey") % 90, F.lit(5), *[F.lit("x")] * 8, F.when(F.col("c_custkey") % 9 == 0, "?").otherwise((F.col("c_custkey") * 3).cast("string"))]
    rows = c.select(F.concat_ws("\t", *[x.cast("string") for x in cells]).alias("value"))
    return readers.places_tsv(spark, _landed(rows, "places", "text")).select("place_id", "name", F.col("lat").cast("long").alias("lat"), "population")


# --- JSON documents
@query("src_11_decoded_rows", "SELECT event_id AS id, lat_e5, frp FROM detections WHERE event_id % 97 <> 0")
def decoded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of decoded rows; one whose shape is unknown is refused as a whole."""
    d = frame(spark, sf_dir, "detections")
    body = F.when(F.col("event_id") % 97 == 0, F.to_json(F.struct(F.lit(9).alias("format"), F.array("event_id").alias("rows")))).otherwise(F.to_json(F.struct(F.lit(1).alias("format"), F.array(F.struct(F.col("event_id").alias("id"), "lat_e5", "frp")).alias("rows"))))
    return documents.strict_rows(d.select(body.alias("body")), "format", 1, "id long, lat_e5 long, frp double").select("id", "lat_e5", "frp")


@query("src_16_pivoted_vectors", "SELECT user_id, event_id, lat_e5, CAST(floor(frp * 10 + 0.5) AS BIGINT) AS frp_e1 FROM detections")
def pivoted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parallel vectors of a product, scaled, to rows."""
    d = frame(spark, sf_dir, "detections")
    v = d.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "lat_e5", F.floor(F.col("frp") * 10 + 0.5).cast("long").alias("frp")))).alias("v"))  # a product's rows
    vectors = v.select("user_id", *[F.transform(F.col("v")[c], lambda x: x * m).alias(c) for c, m in (("event_id", 1), ("lat_e5", 2), ("frp", 5))])
    got = documents.pivoted(vectors, ["user_id"], {"event_id": (1.0, 0.0), "lat_e5": (0.5, 0.0), "frp": (0.2, 0.0)})
    return got.select("user_id", *[F.floor(F.col(c) + 0.5).cast("long").alias(n) for c, n in (("event_id", "event_id"), ("lat_e5", "lat_e5"), ("frp", "frp_e1"))])


@query("src_20_feature_collection", "SELECT fire_id::VARCHAR AS id, lon_e5 AS x, lat_e5 AS y FROM fires WHERE fire_id % 6 <> 5")
def feature_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frame(spark, sf_dir, "fires")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.when(F.col("fire_id") % 6 == 5, "LineString").otherwise("Point").alias("type"), F.array(F.col("lon_e5").cast("double"), F.col("lat_e5").cast("double")).alias("coordinates")).alias("geometry"), F.struct(F.col("fire_id").cast("string").alias("id")).alias("properties"))
    body = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.collect_list(feature).alias("features")))
    bodies = f.groupBy(F.col("fire_id") % 64).agg(body.alias("body")).select("body")
    return documents.point_features(bodies, "id string").select("id", F.col("lon").cast("long").alias("x"), F.col("lat").cast("long").alias("y"))


@query("src_32_activation_detail", "SELECT 'EMSR' || o_custkey AS code, count(*) AS products, count(DISTINCT o_orderpriority) AS areas FROM {orders} GROUP BY o_custkey")
def activation_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    area = o.groupBy("o_custkey", "o_orderpriority").agg(F.collect_list(F.struct(F.col("o_orderkey").cast("string").alias("name"))).alias("products"))
    body = F.to_json(F.struct(F.concat(F.lit("EMSR"), "o_custkey").alias("code"), F.collect_list(F.struct(F.col("o_orderpriority").alias("name"), "products")).alias("aois")))
    got = documents.activation_products(area.groupBy("o_custkey").agg(body.alias("body")).select("body"))
    return got.groupBy("code").agg(F.count("*").alias("products"), F.count_distinct("area").alias("areas"))


@query("src_35_orbit_elements", "SELECT s_suppkey AS norad_id, epoch_us(TIMESTAMP '2024-01-01 00:00:00') + s_suppkey * 60000123 AS epoch_us, s_suppkey % 4 <> 0 AS usable FROM {supplier}")
def orbit_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orbital elements, a quarter of them with an eccentricity that no orbit has."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    epoch = F.date_format(F.timestamp_micros(F.unix_micros(F.lit("2024-01-01").cast("timestamp")) + F.col("s_suppkey") * 60000123), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    body = F.to_json(F.array(F.struct(F.col("s_suppkey").alias("NORAD_CAT_ID"), epoch.alias("EPOCH"), F.lit(14.2).alias("MEAN_MOTION"), F.when(F.col("s_suppkey") % 4 == 0, 1.5).otherwise(0.001).alias("ECCENTRICITY"), F.lit(98.7).alias("INCLINATION"))))
    return documents.orbit_elements(s.select(body.alias("body"))).select("norad_id", F.unix_micros("epoch").alias("epoch_us"), "usable")


@query("src_38_coarse_detections", "SELECT uid, acq_s FROM detections WHERE user_id NOT IN (SELECT user_id FROM detections WHERE source <> 'geo_msg' AND event_id % 50 = 1)")
def coarse_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of coarse detections: a list with an element of another source fails as a whole; repeated uids count once."""
    d = frame(spark, sf_dir, "detections")
    item = F.struct("uid", "acq_s", F.when(F.col("event_id") % 50 == 1, F.col("source")).otherwise("geo_msg").alias("source"))
    lists = d.unionByName(d.filter("event_id % 5 = 0")).groupBy("user_id").agg(F.to_json(F.collect_list(item)).alias("body"))  # a user's list
    return documents.coarse_lists(lists.select("body"), ["geo_msg"]).select("uid", "acq_s")


@query("src_42_manifest", "SELECT n_nationkey AS job, CASE WHEN n_nationkey % 5 = 0 THEN 'version' WHEN n_nationkey % 5 = 1 THEN 'digest' WHEN n_nationkey % 5 = 2 THEN 'plan' ELSE 'accepted' END AS verdict FROM {nation}")
def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("job"))
    k = F.col("job")
    body = F.to_json(F.struct(F.when(k % 5 == 0, 2).otherwise(1).alias("version"), F.when(k % 5 == 1, "other").otherwise("d").alias("digest"), F.when(k % 5 == 2, "other").otherwise("p").alias("plan")))
    return documents.manifest_verdicts(n.select("job", body.alias("body"), F.lit("d").alias("digest"), F.lit("p").alias("plan")), version=1).select("job", "verdict")


@query("src_50_search_results", "SELECT 'W' || p_partkey AS product, p_size AS size FROM {part}")
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    item = F.struct(F.concat(F.lit("W"), "p_partkey").alias("id"), F.struct(F.col("p_size").alias("size")).alias("properties"))
    pages = p.groupBy(F.col("p_partkey") % 50).agg(F.to_json(F.struct(F.count("*").alias("totalResults"), F.collect_list(item).alias("features"))).alias("body"))
    return documents.search_products(pages.select("body")).select("product", F.col("size").cast("int").alias("size"))


# --- writers
@query("snk_16_placemarks", "SELECT '<Placemark><name>' || zone_id || '</name><description>a &amp; b</description><Point><coordinates>' || printf('%.5f', lon) || ',' || printf('%.5f', lat) || '</coordinates></Point></Placemark>' AS line FROM zones")
def placemarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.kml_lines(frame(spark, sf_dir, "zones").withColumn("about", F.lit("a & b")), "zone_id", "about")


@query("snk_18_exposition", "WITH s AS (SELECT r_name, count(*) AS n FROM {nation} JOIN {region} ON r_regionkey = n_regionkey GROUP BY r_name) SELECT 'nations' AS family, 0 AS place, '# HELP nations how many' AS line UNION ALL SELECT 'nations', 1, '# TYPE nations gauge' UNION ALL SELECT 'nations', 2, 'nations{name=\"' || r_name || '\",odd=\"a\\\"b\"} ' || n FROM s")
def exposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/region.parquet")
    s = n.join(r, n["n_regionkey"] == r["r_regionkey"]).groupBy("r_name").agg(F.count("*").alias("value"))
    return sinks.exposition_lines(s.select(F.lit("nations").alias("family"), F.lit("how many").alias("help"), F.lit("gauge").alias("kind"), F.create_map(F.lit("odd"), F.lit('a\\"b'.replace("\\", "")), F.lit("name"), F.col("r_name")).alias("labels"), "value"))


@query("snk_10_promoted_partitions", "SELECT day, count(*) AS n FROM (SELECT uid, acq_s // 86400 AS day, event_id FROM detections WHERE tier = 'NRT' AND acq_s // 86400 % 3 <> 0 UNION ALL SELECT uid, acq_s // 86400, event_id FROM detections WHERE tier = 'SP' AND acq_s // 86400 % 3 = 0) t GROUP BY day")
def promoted_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by day of which every third partition is replaced by staged rows; staged rows with a repeated uid are refused."""
    d = frame(spark, sf_dir, "detections").withColumn("day", F.floor(F.col("acq_s") / 86400))
    where = shared_folder(spark, "promoted")
    sinks.promote(d.filter("tier = 'NRT'").select("uid", "event_id", "day"), where, "day")
    staged = d.filter("tier = 'SP' AND day % 3 = 0").select("uid", "event_id", "day")
    if sinks.promote(staged.unionAll(staged), where, "day")["promoted"] or not sinks.promote(staged, where, "day")["promoted"]:
        raise ValueError("the guard of the partition swap doesn't hold")
    kept = spark.read.parquet(where).join(staged.select("day").distinct().withColumn("_new", F.lit(True)), "day", "left")
    return kept.filter("_new OR day % 3 != 0").groupBy("day").agg(F.count("*").alias("n")).select(F.col("day").cast("long").alias("day"), "n")


@query("snk_19_canonical_json", "SELECT p_partkey, '{\"a\":' || p_size || ',\"b\":{\"x\":\"' || p_brand || '\",\"y\":null},\"c\":[' || p_size || ',' || p_partkey || ']}' AS json FROM {part}")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = p.select("p_partkey", F.struct(F.array(F.col("p_size").cast("long"), "p_partkey").alias("c"), F.struct(F.lit(None).cast("string").alias("y"), F.col("p_brand").alias("x")).alias("b"), F.col("p_size").alias("a")).alias("v"))
    return rows.select("p_partkey", sinks.canonical_json(rows, "v").alias("json"))


@query("snk_07_unpacked_upsert", "SELECT o_custkey, array_to_string(list(o_orderkey || ':' || r ORDER BY r), ',') AS orders FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM {orders}) o GROUP BY o_custkey")
def unpacked_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered keys that arrive as JSON arrays, unpacked with their places and put together again."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    packed = o.groupBy("o_custkey").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda s: s["o_orderkey"])).alias("keys"))
    rows = packed.select("o_custkey", F.posexplode(F.from_json("keys", "array<string>")).alias("place", "key"))
    again = rows.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("place", "key"))).alias("all"))
    return again.select("o_custkey", F.array_join(F.transform("all", lambda s: F.concat_ws(":", s["key"], s["place"] + 1)), ",").alias("orders"))


# --- archives
@query("src_40_archived_rows", "SELECT uid, source, CAST(year(make_timestamp(acq_s * 1000000)) AS INT) AS year, acq_s, lat_e5 FROM detections WHERE source IN ('modis', 'geo_msg')")
def archived_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections as an archive of CSV files by source and year, checked against its manifest; two sources are read back, and only theirs."""
    d = frame(spark, sf_dir, "detections").select("uid", "acq_s", "lat_e5", "source", F.year(F.timestamp_seconds("acq_s")).alias("year"))
    root = shared_folder(spark, "archive")
    archive.publish(d.repartition("source", "year"), root, ["source", "year"], "csv")
    return archive.current(spark, root).filter(F.col("source").isin("modis", "geo_msg")).select("uid", "source", "year", "acq_s", "lat_e5")


@query("src_39_directory_inputs", """
WITH f AS (SELECT n_nationkey AS k, 'body of ' || n_name || chr(10) AS body FROM {nation})
SELECT 'chunk' AS kind, 'P' || k % 3 AS product, sha256(body) AS sha256, length(body) AS bytes FROM f WHERE k % 5 < 3
UNION ALL SELECT 'layer', k || '.geojson', sha256(body), length(body) FROM f WHERE k % 5 = 3
UNION ALL SELECT 'coarse', NULL, sha256(body), length(body) FROM f WHERE k = 4""")
def directory_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of inputs, some files of which are none, found and hashed."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("k", F.col("n_nationkey").cast("int"))
    k = F.col("k")
    place = F.when(k % 5 < 3, F.concat(F.lit("firms/P"), k % 3, F.lit("/2024/"), k, F.lit(".csv"))).when(k % 5 == 3, F.concat(F.lit("effis/"), k, F.lit(".geojson"))).when(k == 4, "geo/detections.json").when(k == 9, "geo/other.json").otherwise(F.concat(F.lit("firms/"), k, F.lit(".csv")))
    root = _tree(n.select(place.alias("path"), F.concat(F.lit("body of "), "n_name").alias("body")))
    return archive.inputs(spark, root).select("kind", "product", "sha256", F.col("bytes").cast("long").alias("bytes"))


def _tree(bodies: DataFrame) -> str:
    """Files with these bodies at these paths below a new folder (bodies are short and few: one row each)."""
    spark, root = bodies.sparkSession, shared_folder(bodies.sparkSession, "tree")
    made = _whole(bodies.withColumn("file", F.col("path")).select("file", F.col("body").alias("value")), "bodies")
    fs, path = spark._jvm.org.apache.hadoop.fs, spark._jvm.org.apache.hadoop.fs.Path
    store = path(made).getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in store.listStatus(path(made)):
        if folder.isDirectory():
            name = spark._jvm.java.net.URLDecoder.decode(folder.getPath().getName().removeprefix("file="), "UTF-8")
            body = next(s.getPath() for s in store.listStatus(folder.getPath()) if s.getPath().getName().startswith("part-"))
            to = path(f"{root}/{name}")
            store.mkdirs(to.getParent())
            fs.FileUtil.copy(store, body, store, to, False, spark._jsc.hadoopConfiguration())
    return root


@query("snk_11_current_generation", "SELECT fire_id, n, started_s FROM fires WHERE fire_id % 3 <> 0")
def current_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three generations the first is replaced and the third never pointed to: a reader sees the second, whole."""
    f, root = frame(spark, sf_dir, "fires").select("fire_id", "n", "started_s"), shared_folder(spark, "generations")
    archive.publish(f.filter("fire_id % 5 = 0"), root)
    archive.publish(f.filter("fire_id % 3 <> 0"), root)
    f.write.parquet(f"{root}/generation-half")
    return archive.current(spark, root)
