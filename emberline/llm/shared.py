"""The shared folder: written tables cut lineage and survive lost executors, whatever machine wrote them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import files
from emberline.operators.graph import shuffles_freed

#: ASCII white space, as the contracts cut words: a Java pattern.
WHITE = r"[\x20\x09-\x0D]+"


def folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; where that is unset, below /tmp/checkpoints, which only one machine may do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/emberline/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read back."""
    spark = df.sparkSession
    path = folder(spark, name)
    with shuffles_freed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


#: Rows of one id up to which they are broadcast: 16 MB of longs.
MOST_IDS = 2_000_000


def few(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked for broadcast if it is small, so that a join with it leaves the other side where it is."""
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote, once all that was made of it has been written too."""
    for table_ in tables:
        files.remove(table_.sparkSession, table_._scratch)


#: Files of a table up to which their names and numbers are broadcast.
MOST_FILES = 50_000


def row_numbers(docs: DataFrame, columns: Sequence[str], name: str = "_node") -> DataFrame:
    """The columns and a long of each row's own: its file's number and its place in the file, the same whenever it is read.

    Rows that come from no file are written first.
    """
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    try:
        placed = docs.select(*columns, *place)
    except AnalysisException:
        placed = written(docs.select(*columns), "rows").select(*columns, *place)
    names = placed.select("_file").distinct()
    names = written(names.repartitionByRange("_file").sortWithinPartitions("_file"), "file-names")
    sizes = names.select(F.col("_metadata.file_name").alias("part"), F.col("_metadata.row_index").alias("at"), "_file")
    before = sizes.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # one row for each partition of the names
    starts, total = [], 0
    for part in before:
        starts.append((part["part"], total))
        total += part["n"]
    if not starts:
        return placed.withColumn(name, F.col("_row")).drop("_file", "_row")
    numbers = sizes.join(F.broadcast(docs.sparkSession.createDataFrame(starts, "part string, start long")), "part").select("_file", (F.col("start") + F.col("at")).alias("_n"))
    joined = placed.join(F.broadcast(numbers) if total <= MOST_FILES else numbers, "_file")
    return joined.select(*columns, (F.shiftleft("_n", 32) + F.col("_row")).alias(name))


def arrow_rows(spark: SparkSession, rows: int = 512) -> None:
    """Whole texts travel to Python in small batches, so that a batch of long ones fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def scored(docs: DataFrame, score: Callable[[pa.Array], list], schema: str, carry: Sequence[str] = (), **given: Column) -> DataFrame:
    """doc_id, the ``given`` columns, what ``score`` makes of a batch's texts (one array for each column of ``schema``), and those to carry.

    Columns to carry pass through as they are, texts too, so that no join has to bring them back; their names must be
    others than those of the rest.
    """
    own, inputs = [c for c in carry if c not in ("doc_id", "text")], [f"_{name}" for name in given]
    rows = docs.select("doc_id", "text", *[column.alias(f"_{name}") for name, column in given.items()], *own)
    kinds = dict(rows.dtypes)
    kept = [c for c in carry if c != "doc_id"]
    made = [tuple(c.split()) for c in schema.split(", ")]
    types = [("doc_id", kinds["doc_id"]), *[(name, kinds[f"_{name}"]) for name in given], *made, *[(c, kinds[c]) for c in kept]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [batch.column("doc_id"), *map(batch.column, inputs), *map(pa.array, score(batch.column("text"))), *map(batch.column, kept)]
            yield pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in types])

    return rows.mapInArrow(run, ", ".join(f"`{name}` {kind}" for name, kind in types))


def crc_mod(key: str, modulus: int):
    """crc32 of an id's decimal text, modulo a number; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
