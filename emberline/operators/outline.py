"""Outlines of events on a grid, made of joins: pixels fill cells, a closing bridges gaps, what is left has an area and a border."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.graph import pieces

#: A cell's side and half a pixel's extent, in hundred-thousandths of a degree.
CELL_E5, HALF_E5 = 200, 300
_AROUND = [(r, c) for r in (-1, 0, 1) for c in (-1, 0, 1)]


def _spread(cells: DataFrame, key: str) -> DataFrame:
    """Each cell and its eight neighbours, as often as they are reached."""
    steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in _AROUND])
    return cells.select(key, "r", "c", F.explode(steps).alias("d")).select(key, (F.col("r") + F.col("d.dr")).alias("r"), (F.col("c") + F.col("d.dc")).alias("c"))


def filled(detections: DataFrame, key: str) -> DataFrame:
    """key, r, c of the cells that pixels touch, each once."""
    side = lambda x: F.sequence(F.floor((F.col(x) - HALF_E5) / CELL_E5).cast("long"), F.floor((F.col(x) + HALF_E5) / CELL_E5).cast("long"))
    rows = detections.select(key, "lat_e5", "lon_e5").distinct().select(key, F.explode(side("lat_e5")).alias("r"), "lon_e5")
    return rows.select(key, "r", F.explode(side("lon_e5")).alias("c")).distinct()


def closed(cells: DataFrame, key: str) -> DataFrame:
    """The cells after dilating and eroding by one: those whose whole neighbourhood is reached."""
    dilated = _spread(cells, key).distinct()
    return _spread(dilated, key).groupBy(key, "r", "c").agg(F.count("*").alias("_n")).filter(F.col("_n") == len(_AROUND)).drop("_n")


def shapes(detections: DataFrame, key: str, *also: str) -> tuple[DataFrame, DataFrame]:
    """(key, shape of each key; shape, lat_e5, lon_e5 and what else of each shape's places): keys whose places differ by whole cells only share a shape.

    Outlines are the same wherever they lie on the grid, so each shape's is made once, however many keys have it.
    """
    at = detections.groupBy(key).agg(F.collect_set(F.struct("lat_e5", "lon_e5", *also)).alias("_at"))
    corner = {c: F.floor(F.array_min(f"_at.{c}") / CELL_E5).cast("long") * CELL_E5 for c in ("lat_e5", "lon_e5")}
    at = at.select(key, "_at", *[v.alias(f"_{c}") for c, v in corner.items()])
    moved = F.array_sort(F.transform("_at", lambda x: F.struct((x["lat_e5"] - F.col("_lat_e5")).alias("lat_e5"), (x["lon_e5"] - F.col("_lon_e5")).alias("lon_e5"), *[x[c].alias(c) for c in also])))
    own = at.select(key, moved.alias("_at")).select(key, F.sha2(F.to_json("_at"), 256).alias("shape"), "_at")
    places = own.groupBy("shape").agg(F.first("_at").alias("_at")).select("shape", F.explode("_at").alias("_p")).select("shape", "_p.*")
    return own.select(key, "shape"), places


def areas(detections: DataFrame, key: str) -> DataFrame:
    """key, cells, edges: the closed outline's size in cells and its border in cell sides.  Order of rows doesn't matter."""
    keys, places = shapes(detections, key)
    return keys.join(_areas(places, "shape"), "shape").drop("shape")


def _areas(detections: DataFrame, key: str) -> DataFrame:
    own = closed(filled(detections, key), key)
    sides = F.explode(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in ((1, 0), (0, 1))]))
    ahead = own.select(key, "r", "c", sides.alias("d")).select(key, (F.col("r") + F.col("d.dr")).alias("r"), (F.col("c") + F.col("d.dc")).alias("c"))
    shared = ahead.join(own, [key, "r", "c"], "left_semi").groupBy(key).agg(F.count("*").alias("_shared"))
    n = own.groupBy(key).agg(F.count("*").alias("cells"))
    return n.join(shared, key, "left").select(key, "cells", (4 * F.col("cells") - 2 * F.coalesce("_shared", F.lit(0))).alias("edges"))


#: Seconds of silence that end a session of detections, and the most points of a series unless all are asked for.
SESSION_S, POINTS = 900, 48


def _growth(places: DataFrame, key: str) -> DataFrame:
    """key, _t, cells, edges: the closed outline's size at each step at which it grows; places have the step _t from which they count.

    A cell is reached from its least step on, the dilation has it from the least of its neighbourhood's, the closing from
    the largest of these: so each cell gets its step once, however many steps follow, and sizes are running sums.
    """
    side = lambda x: F.sequence(F.floor((F.col(x) - HALF_E5) / CELL_E5).cast("long"), F.floor((F.col(x) + HALF_E5) / CELL_E5).cast("long"))
    cells = places.select(key, "_t", F.explode(side("lat_e5")).alias("r"), "lon_e5").select(key, "_t", "r", F.explode(side("lon_e5")).alias("c"))
    steps = F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in _AROUND])
    around = lambda df: df.select(key, "_t", "r", "c", F.explode(steps).alias("d")).groupBy(key, (F.col("r") + F.col("d.dr")).alias("r"), (F.col("c") + F.col("d.dc")).alias("c"))
    dilated = around(cells.groupBy(key, "r", "c").agg(F.min("_t").alias("_t"))).agg(F.min("_t").alias("_t"))
    own = around(dilated).agg(F.max("_t").alias("_t"), F.count("*").alias("_n")).filter(F.col("_n") == len(_AROUND)).drop("_n")
    sides = F.explode(F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in ((1, 0), (0, 1))]))
    ahead = own.select(key, "_t", "r", "c", sides.alias("d")).select(key, F.col("_t").alias("_t0"), (F.col("r") + F.col("d.dr")).alias("r"), (F.col("c") + F.col("d.dc")).alias("c"))
    shared = ahead.join(own, [key, "r", "c"]).select(key, F.greatest("_t0", "_t").alias("_t"), F.lit(0).alias("cells"), F.lit(-2).alias("edges"))
    grown = own.select(key, "_t", F.lit(1).alias("cells"), F.lit(4).alias("edges")).unionAll(shared).groupBy(key, "_t").agg(F.sum("cells").alias("cells"), F.sum("edges").alias("edges"))
    until = Window.partitionBy(key).orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)
    return grown.select(key, "_t", F.sum("cells").over(until).alias("cells"), F.sum("edges").over(until).alias("edges"))


def series(detections: DataFrame, key: str, points: int | None = POINTS) -> DataFrame:
    """key, at_s, cells, edges: the outline of all detections up to each session's end; of more than ``points`` sessions so many, evenly (None: all).

    detections: key, uid, acq_s, lat_e5, lon_e5.  Each place counts from the first session that has it.  Keys whose places and
    sessions differ by whole cells only share a shape, whose growth is worked out once.
    """
    w = Window.partitionBy(key).orderBy("acq_s", "uid")
    starts = F.when(F.col("acq_s") - F.lag("acq_s").over(w) <= SESSION_S, 0).otherwise(1)
    rows = detections.withColumn("_starts", starts).withColumn("_session", F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy(key, "_session").agg(F.max("acq_s").alias("at_s"))
    firsts = rows.groupBy(key, "lat_e5", "lon_e5").agg(F.min("_session").alias("_t"))
    keys, places = shapes(firsts, key, "_t")
    places = places.repartition(pieces(detections), "shape")  # each becomes many cells
    at = ends.join(keys, key).join(_growth(places, "shape").withColumnRenamed("_t", "_session"), ["shape", "_session"], "left")
    order = Window.partitionBy(key).orderBy("_session")
    known = lambda c: F.last(c, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(c)  # noqa: E731  (sessions without a new place)
    at = at.select(key, "_session", "at_s", known("cells"), known("edges"), F.max("_session").over(Window.partitionBy(key)).alias("_n"))
    if points is not None:
        even = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.floor(k * (F.col("_n") - 1) / (points - 1)) + 1)
        at = at.filter((F.col("_n") <= points) | F.array_contains(even, F.col("_session")))
    return at.select(key, "at_s", "cells", "edges")
