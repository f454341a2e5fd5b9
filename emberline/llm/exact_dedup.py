"""Exact deduplication by a stateful stream.

Digests of normalised texts flow through a streaming aggregation whose keyed state (RocksDB on disk, no watermark, so
no expiry) holds for each digest the first stable identifier, the content locator (file and row) of its text, and how
often it came.  Later hits are then checked byte for byte against the text at that locator.  Calls may share a state:
then a later call meets the digests of the earlier ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import files
from emberline.llm.shared import WHITE, discard, folder, written

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Hits of one group that a copy of its kept text is compared with, and files of digests that one micro-batch takes.
PER_SALT, FILES = 500, 64


def normalised(text: str = "text"):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE, " ")


def _located(docs: DataFrame, carry: Sequence[str]) -> DataFrame:
    """doc_id, text, file, row (the place of each row in its file) and carried, a struct; rows that come from no file are written first."""
    wanted = dict.fromkeys(["doc_id", "text", *carry])
    columns = ["doc_id", "text", F.struct(*[c for c in carry if c != "doc_id"]).alias("carried")] if carry else ["doc_id", "text"]
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    if "_metadata" not in docs.columns:
        try:
            return docs.select(*columns, *place)
        except AnalysisException:
            pass
    return written(docs.select(*wanted), "dedup-input").select(*columns, *place)


def _key(call):
    """What decides which of equal texts was first: the call, then the smallest doc_id, then the place in the files."""
    return F.struct(call.cast("int").alias("call"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "file", "row")


def _first_seen(keyed: DataFrame, state: str, files_per_trigger: int) -> DataFrame:
    """digest, first (struct), n of every digest of ``keyed``, by a streaming aggregation that resumes from ``state``."""
    spark = keyed.sparkSession
    keyed.write.mode("append").parquet(f"{state}/keys")
    settings = {"spark.sql.streaming.stateStore.providerClass": STATE_STORE, "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true", "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128", "spark.sql.streaming.stateStore.unloadOnCommit": "true"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    batches = []

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{state}/groups/batch={batch}")
        batches.append(batch)

    try:
        keys = spark.readStream.schema(keyed.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{state}/keys")
        seen = keys.groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n"))
        query = seen.writeStream.outputMode("update").option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    groups = spark.read.schema(seen.schema).parquet(*[f"{state}/groups/batch={b}" for b in batches])
    groups = groups.groupBy("digest").agg(F.min("first").alias("first"), F.max("n").alias("n"))  # a later micro-batch repeats a digest with a larger n
    return written(groups, "dedup-groups-once")  # so that a join with it has no aggregation, and Spark can split a hot digest's rows


def _calls(spark: SparkSession, state: str) -> int:
    """How many calls have kept texts in this state."""
    try:
        return spark.read.parquet(f"{state}/kept").agg(F.coalesce(F.max("call") + 1, F.lit(0))).first()[0]
    except AnalysisException:
        return 0


def exact_dedup(docs: DataFrame, digest_bytes: int = 32, carry: Sequence[str] = (), state: str | None = None, files_per_trigger: int = FILES) -> DataFrame:
    """One row for each document: the columns to carry, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical after each run of ASCII white space became one space; null counts as empty.  The row
    with the smallest doc_id stays (null ids last; of rows with one id, the one that stands first in the files).  An
    empty table gives an empty result; other columns are not read.  ``digest_bytes`` under 32 shortens the state's key,
    for tests of the byte check.

    ``state`` names a folder that calls share: what an earlier call has kept was seen first, whatever its doc_id, and
    group_size counts the rows of all calls.  Each call resumes the stream where the last one stopped; the texts that it
    keeps are stored there for the byte checks of later calls, where different bytes under one digest are an error.
    Without a state the call has one of its own.  The stream takes ``files_per_trigger`` files of digests at a time.
    """
    spark = docs.sparkSession
    rows = _located(docs, carry)
    call = _calls(spark, state) if state else 0
    sha = F.sha2(normalised().cast("binary"), 256)
    keyed = written(rows.select("doc_id", "file", "row", F.substring(F.unhex(sha), 1, digest_bytes).alias("digest"), sha.alias("sha")), "dedup-digests")
    verdict = [F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"), F.col("is_first").alias("kept"), F.col("sha").alias("text_sha256")]
    own = ["carried"] if carry else []
    if keyed.isEmpty():
        found = keyed.join(rows.select("file", "row", *own), ["file", "row"]).withColumns({"first": F.struct("doc_id"), "n": F.lit(1).cast("long"), "is_first": F.lit(True)})
        return found.select("doc_id", *[f"{c}.*" for c in own], *verdict)
    own_state = state or folder(spark, "dedup-state")
    groups = _first_seen(keyed.select("digest", _key(F.lit(call)).alias("key")), own_state, files_per_trigger)
    is_first = (F.col("first.call") == call) & (F.col("file") == F.col("first.file")) & (F.col("row") == F.col("first.row"))
    found = written(keyed.join(groups, "digest").withColumn("is_first", is_first), "dedup-found")
    discard(keyed)
    if not state:
        files.remove(spark, own_state)
        discard(groups)
    if own:  # whole rows travel once, with the verdict
        plain, found = found, written(found.join(rows.select("file", "row", "text", *own), ["file", "row"]), "dedup-carried")
        discard(plain)
    scratch = found._scratch

    # Hits against the bytes of the kept text: group members only; a kept text is repeated for every PER_SALT hits.
    members = found.filter("n > 1")
    members = members.select("file", "row", "digest", "n", "is_first", normalised().alias("norm")) if own else members.select("file", "row", "digest", "n", "is_first").join(rows.select("file", "row", normalised().alias("norm")), ["file", "row"])
    salts = F.ceil(F.col("n") / PER_SALT).cast("int")
    hits = members.filter("NOT is_first").select("digest", F.col("norm").alias("hit"), F.pmod(F.xxhash64("file", "row"), salts.cast("long")).cast("int").alias("salt"))
    kept = members.filter("is_first").select("digest", "n", "norm")
    if call:
        sizes = groups.filter(F.col("first.call") < call).select("digest", "n")
        kept = kept.unionByName(spark.read.parquet(f"{state}/kept").select("digest", "norm").join(sizes, "digest"))
    kept = kept.select("digest", "norm", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    apart = written(hits.join(kept, ["digest", "salt"]).filter("hit != norm").select("digest").distinct(), "dedup-apart")
    if not apart.isEmpty():
        if state:
            raise ValueError("different texts under one digest, in a state that calls share")
        # Different bytes under one digest: such digests are grouped again by the text itself.
        again = found.join(apart, "digest", "left_semi").drop("first", "n", "is_first")
        again = again.withColumn("norm", normalised()) if own else again.join(rows.select("file", "row", normalised().alias("norm")), ["file", "row"])
        exact = again.groupBy("digest", "norm").agg(F.min(_key(F.lit(call))).alias("first"), F.count("*").alias("n"))
        again = again.join(exact, ["digest", "norm"]).withColumn("is_first", is_first)
        found = found.join(apart, "digest", "left_anti").select(*found.columns).unionByName(again.select(*found.columns))
    if state:
        texts = found if own else found.join(rows.select("file", "row", "text"), ["file", "row"])
        texts.filter("is_first").select("digest", normalised().alias("norm"), F.lit(call).alias("call")).write.mode("append").parquet(f"{state}/kept")
    out = found.select("doc_id", *[f"{c}.*" for c in own], *verdict)
    out._scratch = scratch  # what may be deleted once the result has been written
    return out
