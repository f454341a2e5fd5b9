"""Rasters made coarser: shares of groups in blocks of pixels, mixtures named by a dictionary, rows as runs.

Pixels are rows, and those without weight may be left out: a block that none is in is empty, and is counted and put
between the runs without being made a row of.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.graph import shared_checkpoints

#: A dictionary of at most so many mixtures, by what shares can be, is broadcast.
FEW = 1_000_000


def shares(weights: Column, scale: int) -> Column:
    """Whole shares that sum to ``scale``: rounded down, and what is left goes to the largest remainders, the first of equals; none where all is 0."""
    # What is named several times is bound to a lambda's variable, and made once.
    bound = lambda value, of: F.transform(F.array(value), of)[0]
    total = lambda w: F.aggregate(w, F.lit(0.0), lambda s, x: s + x)

    def ranked(exact: Column) -> Column:
        left = F.aggregate(exact, F.lit(scale).cast("long"), lambda s, x: s - F.floor(x))
        order = F.transform(F.array_sort(F.transform(exact, lambda x, i: F.struct((F.floor(x) - x).alias("k"), i.alias("i")))), lambda s: s["i"])
        first = lambda k: F.transform(exact, lambda x, i: F.floor(x) + F.when(F.array_position(k["order"], i) <= k["left"], 1).otherwise(0))
        return bound(F.struct(left.alias("left"), order.alias("order")), first)

    of_total = lambda w, t: F.when(t > 0, bound(F.transform(w, lambda x: x * scale / t), ranked)).otherwise(F.array().cast("array<long>"))
    return bound(weights, lambda w: bound(total(w), lambda t: of_total(w, t)))


def blocks(pixels: DataFrame, groups: int, factor: int, scale: int) -> DataFrame:
    """row, col, key (shares joined by commas) of blocks of ``factor`` by ``factor`` pixels (row, col, group, weight) that hold any weight.

    A pixel with a null group or one that isn't from 0 to ``groups`` - 1 counts for nothing.
    """
    block = lambda c: F.floor(F.col(c) / factor).cast("long").alias(c)
    sums = [F.sum(F.when(F.col("group") == g, F.col("weight")).otherwise(0)).cast("double") for g in range(groups)]
    pooled = pixels.filter(F.col("group").between(0, groups - 1)).groupBy(block("row"), block("col")).agg(F.array(*sums).alias("_w"))
    return pooled.select("row", "col", F.array_join(shares(F.col("_w"), scale).cast("array<string>"), ",").alias("key")).filter("key <> ''")


def dictionary(keyed: DataFrame, empty: int) -> DataFrame:
    """index, key, n of mixtures, the most frequent first, then by key; empty blocks are the mixture '' (none if there are none).

    Mixtures are put in order by ranges and numbered by their place in a range and the sizes of those before, of which
    alone a count by range comes to the driver.
    """
    spark = keyed.sparkSession
    shared_checkpoints(spark)
    counts = keyed.groupBy("key").agg(F.count("*").alias("n"))
    if empty > 0:
        counts = counts.unionByName(spark.range(1).select(F.lit("").alias("key"), F.lit(empty).cast("long").alias("n")))
    ranked = counts.orderBy(F.desc("n"), "key").checkpoint()
    part, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sizes, before, start = {r["p"]: r["n"] for r in ranked.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}, 0, []
    for k in range(max(sizes, default=0) + 1):
        start.append(before)
        before += sizes.get(k, 0)
    return ranked.select((F.get(F.array(*[F.lit(x).cast("long") for x in start]), part) + place).alias("index"), "key", "n")


def down_sampled(pixels: DataFrame, groups: int, factor: int, scale: int, rows: int, cols: int) -> tuple[DataFrame, DataFrame]:
    """Row, runs of the coarse grid, and its dictionary (index, key, n), of a grid of ``rows`` by ``cols`` pixels.

    ``runs`` is an array of (index, length) from west to east, no two neighbours alike.  Every row of the grid has one.
    Blocks at the far sides are pooled from the pixels that they have; a pixel outside the grid is left out.
    """
    if factor < 1 or scale < 1:
        raise ValueError("factor and scale must be at least 1")
    shared_checkpoints(pixels.sparkSession)
    high, wide = -(-rows // factor), -(-cols // factor)
    keyed = blocks(pixels.filter(F.col("row").between(0, rows - 1) & F.col("col").between(0, cols - 1)), groups, factor, scale).checkpoint()
    names = dictionary(keyed, high * wide - keyed.count())
    small = math.comb(scale + groups - 1, groups - 1) < FEW
    named = keyed.join(F.broadcast(names) if small else names, "key").select("row", "col", "index")
    # Runs of the same mixture, in each row: where the last block's column or mixture doesn't lead to this one's, one begins.
    order = Window.partitionBy("row").orderBy("col")
    new = F.when((F.col("col") == F.lag("col").over(order) + 1) & (F.col("index") == F.lag("index").over(order)), 0).otherwise(1)
    held = named.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order)).groupBy("row", "_run", "index").agg(F.min("col").alias("a"), (F.max("col") + 1).alias("b"))
    void = names.filter("key = ''").select(F.col("index").alias("_void"))
    every = pixels.sparkSession.range(high).select(F.col("id").alias("row"))
    listed = every.join(held.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("a", "b", "index"))).alias("_held")), "row", "left").join(F.broadcast(void), how="left")
    none = F.array().cast("array<struct<index:bigint,length:bigint>>")
    run = lambda index, length: F.struct(index.alias("index"), length.cast("long").alias("length"))
    gap = lambda length: F.when(length > 0, F.array(run(F.col("_void"), length))).otherwise(none)
    at = F.coalesce("_held", F.array().cast("array<struct<a:bigint,b:bigint,index:bigint>>"))
    spaced = F.flatten(F.transform(at, lambda x, i: F.concat(gap(x["a"] - F.when(i > 0, F.get(at, i - 1)["b"]).otherwise(0)), F.array(run(x["index"], x["b"] - x["a"])))))
    last = F.coalesce(F.try_element_at(at, F.lit(-1))["b"], F.lit(0))
    return listed.select("row", F.concat(spaced, gap(F.lit(wide) - last)).alias("runs")), names
