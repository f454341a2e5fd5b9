"""The middle of the widest acceptable region of a parameter grid, never its best cell.

Cells (slice, index: whole steps along each dimension) are judged beside their neighbours, one step away along one
dimension of the same slice.  Acceptable cells that neighbours keep stable form regions; how deep a cell lies in its
region is the largest box of acceptable cells around it.  All of it is joins and counts by cell, so grids of any number of
dimensions and slices are judged at once; only the depth takes rounds, as many as the deepest cell is deep.
"""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.graph import remove, shared_folder, shuffles_freed, stars

_SLACK = 1e-9


def _moved(steps: list[tuple[int, ...]]) -> Column:
    """The index moved by each of these steps."""
    return F.explode(F.array(*[F.array(*[F.col("index")[d] + s for d, s in enumerate(step)]) for step in steps]))


def judged(scores: DataFrame, dimensions: int, events: float, f1: float) -> DataFrame:
    """The scores with stable and acceptable, and the neighbours (indexes, sorted) that broke stability.

    scores: slice, index (array<int>), events, f1 (null: unmeasured), meets.  A neighbour breaks stability if its events
    differ by more than that share of the cell's own, if either f1 is unmeasured, or if these differ by more than f1.
    """
    ones = [tuple(s if d == e else 0 for e in range(dimensions)) for d in range(dimensions) for s in (-1, 1)]
    asks = scores.select("slice", "index", "events", "f1", _moved(ones).alias("other"))
    others = scores.select("slice", F.col("index").alias("other"), F.col("events").alias("n"), F.col("f1").alias("g"))
    count = F.when(F.col("events") == 0, F.col("n") == 0).otherwise(F.abs(F.col("n") - F.col("events")) <= events * F.col("events") + _SLACK)
    quality = F.coalesce(F.abs(F.col("g") - F.col("f1")) <= f1 + _SLACK, F.lit(False))
    broke = asks.join(others, ["slice", "other"]).filter(~(count & quality)).groupBy("slice", "index").agg(F.sort_array(F.collect_list("other")).alias("broke"))  # 2 for each dimension at most
    out = scores.join(broke, ["slice", "index"], "left")
    return out.withColumns({"stable": F.col("broke").isNull(), "acceptable": F.col("broke").isNull() & F.col("meets"), "broke": F.coalesce("broke", F.array().cast("array<array<int>>"))})


def inradii(cells: DataFrame, dimensions: int) -> DataFrame:
    """slice, index, inradius of acceptable cells: the largest r so that every cell within r steps along all dimensions is there.

    A cell is deep by one more if its 3^d neighbours, itself among them, are all of the depth before; each round keeps those
    that get as many messages.  A cell at the grid's edge gets fewer, so its inradius is 0.
    """
    spark, base = cells.sparkSession, shared_folder(cells.sparkSession, "inradii")
    around = list(product((-1, 0, 1), repeat=dimensions))

    def put(df: DataFrame, r: int) -> DataFrame:
        with shuffles_freed(spark):
            df.write.parquet(f"{base}/{r}")
        return spark.read.schema(df.schema).parquet(f"{base}/{r}")

    layers = [put(cells.select("slice", "index"), 0)]
    while not layers[-1].isEmpty():
        told = layers[-1].select("slice", _moved(around).alias("index")).groupBy("slice", "index").agg(F.count("*").alias("n"))
        layers.append(put(told.filter(F.col("n") == len(around)).select("slice", "index"), len(layers)))
    every = reduce(DataFrame.unionByName, [layer.withColumn("r", F.lit(r)) for r, layer in enumerate(layers)])
    found = put(every.groupBy("slice", "index").agg(F.max("r").alias("inradius")), len(layers))
    for r in range(len(layers)):
        remove(spark, f"{base}/{r}")
    return found


def regions(cells: DataFrame, dimensions: int) -> DataFrame:
    """slice, index, inradius, region (a cell's name) of acceptable cells; cells that neighbours connect are one region."""
    name = lambda index: F.concat_ws("@", "slice", F.array_join(F.col(index).cast("array<string>"), ","))
    ahead = [tuple(int(d == e) for e in range(dimensions)) for d in range(dimensions)]
    asks = cells.select("slice", "index", _moved(ahead).alias("other"))
    linked = asks.join(cells.select("slice", F.col("index").alias("other")), ["slice", "other"]).select(name("index").alias("x"), name("other").alias("y"))
    deep = inradii(cells, dimensions).withColumn("node", name("index"))
    return deep.join(stars(linked), "node", "left").select("slice", "index", "inradius", F.coalesce("root", "node").alias("region"))


def ranked(members: DataFrame, dimensions: int) -> DataFrame:
    """place (1: widest), slice, cells, width, centre of each region of ``regions``.

    Wider first, then more cells, then the slice, then the smallest index.  The centre is, of the region's deepest cells, the
    one nearest to the mean of its indexes, then the smallest index; distances are compared in whole numbers.
    """
    sums = [F.sum(F.col("index")[d]).alias(f"s{d}") for d in range(dimensions)]
    whole = members.groupBy("region").agg(F.first("slice").alias("slice"), F.count("*").alias("cells"), F.max("inradius").alias("width"), F.min("index").alias("least"), *sums)
    far = reduce(Column.__add__, [(F.col("cells") * F.col("index")[d] - F.col(f"s{d}")) * (F.col("cells") * F.col("index")[d] - F.col(f"s{d}")) for d in range(dimensions)])
    deepest = members.drop("slice").join(whole, "region").filter("inradius = width").groupBy("region").agg(F.min(F.struct(far.alias("far"), "index")).alias("near"))
    place = F.row_number().over(Window.orderBy(F.desc("width"), F.desc("cells"), "slice", "least"))  # a row for each region
    return whole.join(deepest, "region").withColumn("place", place).select("place", "slice", "cells", "width", F.col("near.index").alias("centre"))


def plateaus(scores: DataFrame, dimensions: int, events: float, f1: float) -> DataFrame:
    """The ranked regions of a grid of scores; the first row's centre is what to choose, and no row means no choice.

    Two scores for a cell, or an index of another length, are an error.
    """
    wrong = scores.filter((F.size("index") != dimensions) | F.exists("index", lambda i: i < 0)).select("slice", "index")
    again = scores.groupBy("slice", "index").count().filter("count > 1").select("slice", "index")
    if bad := wrong.unionByName(again).first():
        raise ValueError(f"no such cell, or two scores for one: {bad['slice']} {bad['index']}")
    accepted = judged(scores, dimensions, events, f1).filter("acceptable").select("slice", "index")
    return ranked(regions(accepted, dimensions), dimensions)
