"""Matching within tolerances of time and place, one to one and in order, without a table of the pairs.

What a row can still claim depends on what earlier ones claimed, so rows are taken in order.  But rows in unconnected cells,
or on two sides of a silence longer than the tolerance, never meet: rows are dealt by the connected component of
occupied cells and by the stretch between silences, and streamed in order of time through an engine that holds the
unclaimed rows within the tolerance only.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.graph import shared_checkpoints, smallest_reachable

_OUT = "l_key string, r_key string, acq_delta long, coord_delta long"
_AROUND = [(r, c) for r in (0, -1, 1) for c in (0, -1, 1)]  # a row's own cell first, as the nearest is likely there


class Engine:
    """The unclaimed extra rows of one component, in each cell by (acq_s, uid)."""

    def __init__(self, seconds: int, e5: int) -> None:
        self.seconds, self.e5 = seconds, e5
        self.cells: dict[tuple[int, int], list[tuple]] = defaultdict(list)

    def _passed(self, cell: list[tuple], now: int) -> None:
        if cell and cell[0][0] < now - self.seconds:
            del cell[: bisect_left(cell, (now - self.seconds,))]

    def hold(self, row: int, column: int, acq_s: int, uid: str, lat: int, lon: int, now: int) -> None:
        cell = self.cells[row, column]
        self._passed(cell, now)
        cell.append((acq_s, uid, lat, lon))

    def claim(self, row: int, column: int, acq_s: int, lat: int, lon: int) -> tuple | None:
        """(by time, by coordinate, uid, signed time) of the nearest row within reach, which is then gone."""
        best, where, far = None, None, self.seconds
        for r, c in _AROUND:
            cell = self.cells.get((row + r, column + c))
            if not cell:
                continue
            self._passed(cell, acq_s)
            start = bisect_left(cell, (acq_s,))
            for places in (range(start, len(cell)), range(start - 1, -1, -1)):
                for k in places:
                    at, uid, y, x = cell[k]
                    dt = abs(at - acq_s)
                    if dt > far:
                        break
                    dx = max(abs(y - lat), abs(x - lon))
                    if dx <= self.e5 and (best is None or (dt, dx, uid) < best[:3]):
                        best, where, far = (dt, dx, uid, at - acq_s), (cell, k), dt
        if where:
            del where[0][where[1]]
        return best


def _streamed(seconds: int, e5: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, engine = None, Engine(seconds, e5)
        for batch in batches:
            rows = []
            for component, stretch, now, kind, uid, acq_s, lat, lon, r, c in zip(*[batch[x].tolist() for x in batch.columns], strict=True):
                if (component, stretch) != part:
                    part, engine = (component, stretch), Engine(seconds, e5)
                if kind == 0:
                    engine.hold(r, c, acq_s, uid, lat, lon, now)
                elif found := engine.claim(r, c, acq_s, lat, lon):
                    rows.append((uid, found[2], found[3], found[1]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")]).astype({"acq_delta": "int64", "coord_delta": "int64"})

    return run


def _dealt(rows: DataFrame, seconds: int) -> DataFrame:
    """Rows (acq_s, _r, _c) with their component and stretch.  Cells and their times are one table, joined with the rows once.

    A silence longer than the tolerance is found between a component's buckets of that length.
    """
    rows = rows.withColumns({"node": F.shiftleft("_r", 32) + F.col("_c"), "_t": F.floor(F.col("acq_s") / max(seconds, 1)).cast("long")})
    times = rows.groupBy("node", "_r", "_c", "_t").agg(F.min("acq_s").alias("_first"), F.max("acq_s").alias("_last")).checkpoint()
    cells = times.select("node", "_r", "_c").distinct()
    around = cells.select(F.col("node").alias("a"), F.explode(F.sequence(F.col("_r") - 1, F.col("_r") + 1)).alias("r"), "_c").select("a", "r", F.explode(F.sequence(F.col("_c") - 1, F.col("_c") + 1)).alias("c"))
    edges = around.select("a", (F.shiftleft("r", 32) + F.col("c")).alias("b")).filter("a != b").join(cells.select(F.col("node").alias("b")), "b", "left_semi")
    parts = smallest_reachable(cells.select("node"), edges).withColumnRenamed("root", "component")
    times = times.join(parts, "node")
    spans = times.groupBy("component", "_t").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last"))
    w = Window.partitionBy("component").orderBy("_t")
    silent = F.col("_first") - F.max("_last").over(w.rowsBetween(Window.unboundedPreceding, -1)) > seconds
    spans = spans.withColumn("_cut", F.coalesce(silent, F.lit(False)).cast("int")).select("component", "_t", F.sum("_cut").over(w).alias("stretch"))
    return rows.join(times.select("node", "_t", "component").join(spans, ["component", "_t"]), ["node", "_t"])


def tolerance_pairs(missing: DataFrame, extra: DataFrame, seconds: int, e5: int) -> DataFrame:
    """l_key, r_key, acq_delta, coord_delta: missing rows in order of (acq_s, uid) each claim the nearest extra row in time and place.

    Both have uid, acq_s, lat_e5, lon_e5 (whole numbers); rows that lack one take no part, and of a side's repeated uids the
    earliest counts.  Nearest: by time, then by the larger difference of coordinates, then by uid.
    """
    shared_checkpoints(missing.sparkSession)
    side = max(e5, 1)
    sides = []
    for df, kind in ((extra, 0), (missing, 1)):
        d = df.select("uid", *[F.col(c).cast("long").alias(c) for c in ("acq_s", "lat_e5", "lon_e5")]).dropna()
        d = d.groupBy("uid").agg(F.min(F.struct("acq_s", "lat_e5", "lon_e5")).alias("v")).select("uid", "v.*")
        sides.append(d.withColumn("kind", F.lit(kind)))
    rows = sides[0].unionByName(sides[1]).withColumns({"_r": F.floor(F.col("lat_e5") / side).cast("long"), "_c": F.floor(F.col("lon_e5") / side).cast("long")})
    now = F.when(F.col("kind") == 0, F.col("acq_s") - seconds).otherwise(F.col("acq_s"))  # an extra row is held from when it can be claimed
    columns = ["component", "stretch", "now", "kind", "uid", "acq_s", "lat_e5", "lon_e5", "_r", "_c"]
    ordered = _dealt(rows, seconds).withColumn("now", now).select(*columns).repartition("component", "stretch").sortWithinPartitions(*columns[:5])
    return ordered.mapInPandas(_streamed(seconds, e5), _OUT)
