"""What is held of a sliding span of time: the newest product of each window, while the window is inside the retention.

Products of one window replace each other by publication, then arrival, then id, so the result never depends on the order
in which overlapping fetches bring them.  The stream's state is one product a window; the watermark drops what is past the
retention, rows and state alike.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PRODUCTS = "start_s long, end_s long, id string, published_s long, available_s long, flashes array<struct<at_s: long, x: long, y: long>>"
_NEVER = -(2**62)


def version() -> Column:
    """What decides between products of a window: the largest wins."""
    return F.struct(F.coalesce("published_s", F.lit(_NEVER)).alias("p"), F.coalesce("available_s", F.lit(_NEVER)).alias("a"), "id", F.struct("published_s", "available_s", "flashes").alias("rest"))


def _flat(best: DataFrame) -> DataFrame:
    return best.select("start_s", "end_s", "best.id", "best.rest.*")


def held(products: DataFrame, now_s: int, retention_s: int) -> DataFrame:
    """The newest product of each window that ends after the cut, with the flashes after it."""
    best = products.filter(F.col("end_s") > now_s - retention_s).groupBy("start_s", "end_s").agg(F.max(version()).alias("best"))
    return _flat(best).withColumn("flashes", F.filter("flashes", lambda f: f["at_s"] > now_s - retention_s))


def slide(spark: SparkSession, landing: str, where: str, retention_s: int, files: int = 4) -> StreamingQuery:
    """Take what has landed since the last call: windows whose product changed go to a folder for each batch, overwritten if the batch comes again."""
    rows = spark.readStream.schema(PRODUCTS).option("maxFilesPerTrigger", files).json(landing)
    at = rows.withColumn("end_at", F.timestamp_seconds("end_s")).withWatermark("end_at", f"{retention_s} seconds")
    best = at.groupBy("start_s", "end_s", "end_at").agg(F.max(version()).alias("best"))

    def put(df: DataFrame, batch: int) -> None:
        _flat(df).write.mode("overwrite").parquet(f"{where}/held/batch={batch}")

    return best.writeStream.outputMode("update").option("checkpointLocation", f"{where}/offsets").trigger(availableNow=True).foreachBatch(put).start()


def document(spark: SparkSession, where: str, now_s: int, retention_s: int) -> DataFrame:
    """What the stream holds at a moment, with the same columns as ``held``."""
    try:
        every = spark.read.parquet(f"{where}/held")
    except AnalysisException:
        every = spark.createDataFrame([], PRODUCTS)
    return held(every.select([c.split()[0] for c in PRODUCTS.split(", ")[:5]] + ["flashes"]), now_s, retention_s)
