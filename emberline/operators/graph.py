"""Connected components as stars: rounds grow with the logarithm of a component, whatever its shape."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_checkpoints(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; one of this machine only where that is unset and all runs on one, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_checkpoints(spark)}/emberline/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark can write."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within this, the shuffle files of a job that writes a table are deleted once the table is written, not when the driver forgets them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, True)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _written(df: DataFrame, path: str) -> DataFrame:
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(df: DataFrame, megabytes: int = 2) -> int:
    """Into how many parts rows are dealt of which each becomes many or wide: so much of the input in each, by the planner's estimate, and no fewer than a shuffle's.

    Without a number Spark merges parts by the bytes that are shuffled, which say little of what a task then holds.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // (megabytes << 20), 20_000))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, kept as a table in the shared folder: much smaller there than a checkpoint's rows, and read by columns."""
    return _written(df, shared_folder(df.sparkSession, name))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of its neighbours and itself."""
    both = edges.select("x", "y").unionAll(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    least = both.groupBy("x").agg(F.least("x", F.min("y")).alias("least"))
    return both.filter("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("least").alias("y")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of these (in every edge y < x)."""
    least = edges.groupBy("x").agg(F.min("y").alias("least"))
    moved = edges.join(least, "x").filter("y != least").select(F.col("y").alias("x"), F.col("least").alias("y"))
    return moved.unionAll(least.select("x", F.col("least").alias("y"))).distinct()


def stars(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """node, root of every node of the edges (x, y): the smallest node that can be reached.  ``rounds`` gets their number.

    Alternates large and small stars (Kiveris et al., Connected components in MapReduce and beyond) until no edge
    changes; then every edge leads to its component's smallest node.  Each round is one written table in the shared
    folder, so lost executors cost no history, and the one before it is deleted; a round's count and checksum of edges
    come to the driver.  Edges of a node with itself and null ends are no edges.
    """
    spark = edges.sparkSession
    base, n, before = shared_folder(spark, "stars"), 0, None
    told = [F.count("*"), F.bit_xor(F.xxhash64("x", "y"))]
    now = _written(edges.filter("x != y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), f"{base}/0")
    while True:
        known = now.agg(*told).first()
        if known == before:
            break
        n, before = n + 1, known
        now = _written(_small_star(_large_star(now)), f"{base}/{n}")
        remove(spark, f"{base}/{n - 1}")
    if rounds is not None:
        rounds.append(n)
    found = now.select(F.col("x").alias("node"), F.col("y").alias("root")).unionAll(now.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
    found._scratch = base  # what may be deleted once the result has been used
    return found


def smallest_reachable(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root of every node (column node): the smallest node that edges (a, b, in both directions) lead to."""
    found = stars(edges.select(F.col("a").alias("x"), F.col("b").alias("y")))
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
