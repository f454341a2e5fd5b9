"""Consumers of a change feed: rows with a sequence number, taken in small batches, decided on and written once.

What a batch leaves is in folders of its own, overwritten if the batch comes again, and the batch's number is the stream's,
so outbox and cursor move together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberline.operators.graph import shared_checkpoints
from emberline.streaming.ingest import latest_by_seq


#: Batches after which the newest seq of each key is written anew, so that a batch never reads more of the cursor than that.
COMPACT = 16


def _held(spark: SparkSession, path: str, low: int, high: int) -> DataFrame | None:
    """A table's rows of the batches from low to before high; None if there are none."""
    try:
        return spark.read.parquet(path).filter((F.col("batch") >= low) & (F.col("batch") < high)).select("key", "seq")
    except AnalysisException:
        return None


def cursor(spark: SparkSession, where: str, batch: int) -> DataFrame | None:
    """key, seq of what the batches before this one took: the newest whole cursor, and the batches since."""
    whole = batch // COMPACT * COMPACT
    parts = [df for df in (_held(spark, f"{where}/cursor-whole", whole, whole + 1), _held(spark, f"{where}/cursor", whole, batch)) if df is not None]
    return parts[0].unionByName(parts[1]) if len(parts) == 2 else parts[0] if parts else None


def consume_batch(rows: DataFrame, batch: int, where: str, decide: Callable[[DataFrame], DataFrame]) -> None:
    """The newest change of each key (key, seq, ...) that is newer than what earlier batches took goes to ``decide``; what that gives to the outbox."""
    spark = rows.sparkSession
    shared_checkpoints(spark)
    if batch and batch % COMPACT == 0:  # all batches before, once; a repeated batch writes the same again
        held = [df for df in (_held(spark, f"{where}/cursor-whole", batch - COMPACT, batch - COMPACT + 1), _held(spark, f"{where}/cursor", batch - COMPACT, batch)) if df is not None]
        if held:
            every = held[0].unionByName(held[1]) if len(held) == 2 else held[0]
            every.groupBy("key").agg(F.max("seq").alias("seq")).write.mode("overwrite").parquet(f"{where}/cursor-whole/batch={batch}")
    new = latest_by_seq(rows)
    if (seen := cursor(spark, where, batch)) is not None:
        last = seen.join(new.select("key"), "key", "left_semi").groupBy("key").agg(F.max("seq").alias("_seen"))
        new = new.join(last, "key", "left").filter(F.col("_seen").isNull() | (F.col("seq") > F.col("_seen"))).drop("_seen")
    new = new.checkpoint()
    decide(new).write.mode("overwrite").parquet(f"{where}/outbox/batch={batch}")
    new.select("key", "seq").write.mode("overwrite").parquet(f"{where}/cursor/batch={batch}")


def consume(spark: SparkSession, landing: str, schema: str, where: str, decide: Callable[[DataFrame], DataFrame], files: int = 4) -> StreamingQuery:
    """Take what has landed since the last call, a few files a batch, and stop; the stream's own offsets are the cursor of the feed."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(landing)
    return rows.writeStream.option("checkpointLocation", f"{where}/offsets").trigger(availableNow=True).foreachBatch(lambda df, i: consume_batch(df, i, where, decide)).start()
