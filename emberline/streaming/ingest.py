"""The ingest stream: landed CSV files, validated, into an archive, a quarantine and a ledger that a repeated batch doesn't change."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberline.operators.graph import shared_checkpoints
from emberline.operators.ingest import append_new, validated
from emberline.sources.readers import CSV_COLUMNS, detections_of


def _others(spark: SparkSession, path: str, batch: int, keys: DataFrame, at: str) -> DataFrame:
    """The keys that other batches have left in a table's folders, of the span of times that these keys have."""
    try:
        held = spark.read.parquet(path)
    except AnalysisException:  # the first batch finds no table
        return keys.limit(0)
    first, last = keys.agg(F.min(at), F.max(at)).first()
    return held.filter((F.col("batch") != batch) & F.col(at).between(first, last)).select(*keys.columns)


def ingest_batch(rows: DataFrame, batch: int, where: str, source: str) -> None:
    """One micro-batch: each table has a folder for each batch, overwritten if the batch comes again, and new keys only."""
    spark = rows.sparkSession
    shared_checkpoints(spark)
    checked = validated(detections_of(rows, source)).checkpoint()
    good = checked.filter("size(violations) = 0").drop("violations")
    earlier = _others(spark, f"{where}/archive", batch, good.select("acq_s", "uid"), "acq_s")
    append_new(good, earlier, ["acq_s", "uid"]).write.mode("overwrite").parquet(f"{where}/archive/batch={batch}")
    checked.filter("size(violations) > 0").write.mode("overwrite").parquet(f"{where}/quarantine/batch={batch}")
    ledger = checked.groupBy("source", "available_s").agg(F.count("*").alias("rows"), F.count_if(F.size("violations") > 0).alias("rejected"))
    ledger.write.mode("overwrite").parquet(f"{where}/ledger/batch={batch}")


def ingest_stream(spark: SparkSession, landing: str, where: str, source: str, arrived: str | None = None) -> StreamingQuery:
    """Read what has landed since the last call, a few files a batch, and stop; offsets are kept below ``where``.

    Rows arrived when their file was last written, or when a column of theirs (``arrived``, the last one) says.
    """
    schema = f"{CSV_COLUMNS}, {arrived} long" if arrived else CSV_COLUMNS
    rows = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", 4).csv(landing)
    rows = rows.withColumn("available_s", F.col(arrived) if arrived else F.unix_seconds("_metadata.file_modification_time"))
    return rows.writeStream.option("checkpointLocation", f"{where}/offsets").trigger(availableNow=True).foreachBatch(lambda df, i: ingest_batch(df, i, where, source)).start()


def latest_by_seq(changes: DataFrame) -> DataFrame:
    """key, seq, row of the newest change of each key: a late change with a smaller seq never replaces what is held."""
    rest = F.struct(*[c for c in changes.columns if c != "key"])
    return changes.groupBy("key").agg(F.max("seq").alias("seq"), F.max_by(rest, "seq").alias("row"))
