"""Reproducible shuffle: a Feistel permutation of global row numbers, cycle-walked into their range.

Rows are numbered 0..n-1 in doc_id order.  The permuted number p of a row is its place in the shuffle; its shard is
p mod shards and its slot p div shards, so both can be computed, and inverted, from the number and the key alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.shared import folder

ROUNDS = 4


def _mix(x: np.ndarray, key: int, rnd: int) -> np.ndarray:
    """A 64-bit finaliser of a half, the key and the round."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((key * 0x9E3779B97F4A7C15 + rnd * 0xD1B54A32D192ED03) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permute(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """The place of each row number in a shuffle of n rows (or, inverted, the row number at each place)."""
    half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
    mask = np.uint64((1 << int(half)) - 1)
    out = np.asarray(x, dtype=np.uint64).copy()
    walking = np.ones(len(out), dtype=bool)
    while walking.any():  # values beyond n go round again; a domain of under 4n makes that few rounds
        left, right = out[walking] >> half, out[walking] & mask
        for r in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
            if inverse:
                left, right = right ^ (_mix(left, key, r) & mask), left
            else:
                left, right = right, left ^ (_mix(right, key, r) & mask)
        out[walking] = (left << half) | right
        walking = out >= np.uint64(n)
    return out.astype(np.int64)


def numbered(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """``rows`` with a gapless ``row_number`` (long, from 0) in the given order, and how many there are.

    Range-partitioned and sorted rows are written once; a row's number is its place in its file plus the rows of the
    files before.  Only the files' sizes, one row for each partition, are brought together.
    """
    spark = rows.sparkSession
    path = folder(spark, name)
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", 0).parquet(path)
    back = spark.read.schema(rows.schema).parquet(path).withColumns({"_file": F.col("_metadata.file_name"), "_row": F.col("_metadata.row_index")})
    sizes = back.groupBy("_file").agg(F.count("*").alias("_n")).orderBy("_file").collect()  # one row for each partition
    starts, total = [], 0
    for s in sizes:  # part-00000-..., part-00001-...: names sort as the ranges do
        starts.append((s["_file"], total))
        total += s["_n"]
    if not starts:
        return rows.limit(0).withColumn("row_number", F.lit(0).cast("long")), 0
    offsets = spark.createDataFrame(starts, "_file string, _start long")
    return back.join(F.broadcast(offsets), "_file").withColumn("row_number", F.col("_start") + F.col("_row")).drop("_file", "_row", "_start"), total


def shard_documents(docs: DataFrame, shards: int = 16, key: int = 42) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row; the law is ``rows`` (counts at most one apart).

    Size is the text's UTF-8 bytes plus 1 (null text: 1, checksum of no bytes).  Rows are numbered by doc_id (null ids
    first), then size and checksum, so repeated rows get places of their own and equal ones are interchangeable.  An
    empty table gives an empty result; other columns are not read.
    """
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows, n = numbered(docs.select("doc_id", (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32")), ["doc_id", "size", "text_crc32"], "shard-rows")

    @F.pandas_udf("long")
    def place(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), n, key))

    rows = rows.withColumn("place", place("row_number"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"), F.floor(F.col("place") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number")
