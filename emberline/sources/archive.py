"""Archives in folders: generations that become visible as a whole, manifests of file hashes that are checked before rows are given, directory scans.

A generation is written to a folder of its own, then its manifest, and last a pointer of one row; a reader follows the
pointer, so it sees all of a generation or none.  Hashes are made and compared where the files are, by joins; no list of
files comes to the driver.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_POINTER = "at long, folder string, schema string, format string"


def hashed(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """path (below the folder), bytes, sha256 of every file in a folder and those below it."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    top = folder.rstrip("/").rpartition("/")[2]
    below = F.expr(f"substring(path, instr(path, '/{top}/') + {len(top) + 2})")
    return found.select(below.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def publish(rows: DataFrame, root: str, by: list[str] | None = None, kind: str = "parquet", rows_per_file: int = 1_000_000) -> str:
    """Write a generation, in folders by these columns, and point to it; gives its folder.  What was current stays until then."""
    spark, folder = rows.sparkSession, f"{root}/generation-{uuid.uuid4().hex}"
    write = rows.write.format(kind).option("maxRecordsPerFile", rows_per_file)
    (write.partitionBy(*by) if by else write).save(folder)
    hashed(spark, folder, "part-*").write.parquet(f"{folder}-manifest")
    now = rows.sparkSession.range(1).select(F.unix_micros(F.current_timestamp()).alias("at"), F.lit(folder).alias("folder"), F.lit(_ddl(rows, by or [])).alias("schema"), F.lit(kind).alias("format"))
    now.write.mode("append").parquet(f"{root}/pointer")
    return folder


def _ddl(rows: DataFrame, by: list[str]) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in [*[c for c in rows.columns if c not in by], *by])


def current(spark: SparkSession, root: str, check: bool = True) -> DataFrame:
    """The rows of the generation that is pointed to; filters on its folders' columns read only those folders.

    With ``check`` every file is compared with the manifest first: a file that is changed, missing or not listed is an
    error that names it.
    """
    try:
        found = spark.read.schema(_POINTER).parquet(f"{root}/pointer").orderBy(F.desc("at"), "folder").first()
    except AnalysisException:
        found = None
    if found is None:
        raise ValueError(f"nothing has been published in {root}")
    if check and (bad := faults(spark, found["folder"]).orderBy("path").first()):
        raise ValueError(f"{bad['fault']}: {bad['path']}")
    return spark.read.format(found["format"]).schema(found["schema"]).option("basePath", found["folder"]).load(found["folder"])


def faults(spark: SparkSession, folder: str) -> DataFrame:
    """path, fault (changed, missing, unlisted) of files that differ from a generation's manifest."""
    have, want = hashed(spark, folder, "part-*").alias("h"), spark.read.parquet(f"{folder}-manifest").alias("w")
    both = have.join(want, "path", "full_outer")
    fault = F.when(F.col("h.sha256").isNull(), "missing").when(F.col("w.sha256").isNull(), "unlisted").when(F.col("h.sha256") != F.col("w.sha256"), "changed")
    return both.select("path", fault.alias("fault")).filter("fault IS NOT NULL")


def inputs(spark: SparkSession, root: str) -> DataFrame:
    """kind, product, path, bytes, sha256 of the inputs of a fit: chunks by product and year, layers, and one file of coarse detections; other files are none."""
    files = hashed(spark, root)
    part = lambda pattern, k: F.regexp_extract("path", pattern, k)
    chunk: Column = F.col("path").rlike(r"^firms/[^/]+/[^/]+/[^/]+\.csv$")
    kind = F.when(chunk, "chunk").when(F.col("path").rlike(r"^effis/[^/]+\.geojson$"), "layer").when(F.col("path") == "geo/detections.json", "coarse")
    product = F.when(chunk, part("^firms/([^/]+)/", 1)).when(kind == "layer", part(r"^effis/([^/]+)$", 1))
    return files.select(kind.alias("kind"), product.alias("product"), "path", "bytes", "sha256").filter("kind IS NOT NULL")
