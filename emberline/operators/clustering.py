"""Incremental single-linkage clustering in arrival order.

A detection may bridge clusters, so order matters and plain components are not enough.  But no two detections whose
grid cells are unconnected can ever meet, and none that arrives after a silence longer than clusters stay active can meet
what came before: rows are dealt by the connected component of occupied cells and by the stretch between silences, sorted
in arrival order within it, and streamed through an engine that remembers live clusters only.  Its memory follows what is
active at one time, not how many rows a place has.  Merges come out as links and are resolved by a join.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from math import floor, sqrt

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline import params as p
from emberline.operators.graph import smallest_reachable
from emberline.operators.ingest import link_distance_km
from emberline.operators.joins import closure

#: Cells of a tenth of a degree are wider than any link distance, so that neighbours hold all candidates.
CELLS = 10
ORDER = ["available_s", "source", "lat_e5", "lon_e5", "uid"]
_OUT = "uid string, cluster string, outcome string, gone string"


def _quanta(lat1: float, lon1: float, lat2: float, lon2: float) -> int:
    dy = (lat2 - lat1) * p.KM_LAT
    dx = (lon2 - lon1) * (p.KM_LON + p.KM_LON_SLOPE * ((lat1 + lat2) / 2 - p.REF_LAT))
    return floor(sqrt(dx * dx + dy * dy) / p.KM_QUANTUM + 0.5)


class Engine:
    """Live clusters of one component.  A cluster's name is the uid that seeded it."""

    def __init__(self) -> None:
        self.clusters: dict[str, dict] = {}
        self.cells: dict[tuple[int, int], dict[str, set]] = defaultdict(lambda: defaultdict(set))

    def _drop(self, name: str) -> dict:
        gone = self.clusters.pop(name)
        for cell in {(floor(a * CELLS), floor(b * CELLS)) for a, b in gone["points"]}:
            self.cells[cell].pop(name, None)
            if not self.cells[cell]:
                del self.cells[cell]
        return gone

    def _hold(self, name: str, lat: float, lon: float) -> None:
        self.clusters[name]["points"].add((lat, lon))
        self.cells[floor(lat * CELLS), floor(lon * CELLS)][name].add((lat, lon))

    def step(self, uid: str, acq_s: int, now_s: int, lat: float, lon: float, eps_km: float, coarse: bool) -> list[tuple]:
        """(uid, cluster, outcome, gone) of one detection: attached, seeded or unattached, after the merges it causes."""
        bound, nearest = floor(eps_km / p.KM_QUANTUM + 0.5), {}
        row, column = floor(lat * CELLS), floor(lon * CELLS)
        for cell in ((r, c) for r in (row - 1, row, row + 1) for c in (column - 1, column, column + 1)):
            for name, points in list(self.cells.get(cell, {}).items()):
                c = self.clusters[name]
                if now_s - c["last"] > p.ACTIVE_H * 3600:
                    self._drop(name)
                elif max(c["start"] - acq_s, acq_s - c["last"], 0) <= p.T_LINK_H * 3600:
                    q = min(_quanta(a, b, lat, lon) for a, b in points)
                    if q <= bound:
                        nearest[name] = min(q, nearest.get(name, q))
        nearest = {k: q for k, q in nearest.items() if k in self.clusters}
        if not nearest:
            if coarse:
                return [(uid, None, "unattached", None)]
            self.clusters[uid] = {"start": acq_s, "last": acq_s, "n": 1, "points": set()}
            self._hold(uid, lat, lon)
            return [(uid, uid, "seeded", None)]
        out = []
        if coarse or len(nearest) == 1:
            own = min(nearest, key=lambda k: (nearest[k], k))
        else:
            own = min(nearest, key=lambda k: (self.clusters[k]["start"], -self.clusters[k]["n"], k))
            for other in sorted(set(nearest) - {own}):
                gone, kept = self._drop(other), self.clusters[own]
                kept |= {"start": min(kept["start"], gone["start"]), "last": max(kept["last"], gone["last"]), "n": kept["n"] + gone["n"]}
                for a, b in gone["points"]:
                    self._hold(own, a, b)
                out.append((uid, own, "merged", other))
        c = self.clusters[own]
        c |= {"start": min(c["start"], acq_s), "last": max(c["last"], acq_s), "n": c["n"] + 1}
        self._hold(own, lat, lon)
        return [*out, (uid, own, "attached", None)]


def _streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part, engine = None, Engine()
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            if r.part != part:
                part, engine = r.part, Engine()
            rows += engine.step(r.uid, r.acq_s, r.available_s, r.lat, r.lon, r.eps_km, r.coarse)
        yield pd.DataFrame(rows, columns=["uid", "cluster", "outcome", "gone"])


def stretches(rows: DataFrame) -> DataFrame:
    """Rows (component, available_s, acq_s) with their stretch: a new one begins where all clusters so far are past being active.

    A silence of that length spans days, so it is found between a component's days of arrival.
    """
    rows = rows.withColumn("_day", F.floor(F.col("available_s") / 86400))
    days = rows.groupBy("component", "_day").agg(F.min("available_s").alias("_first"), F.max("acq_s").alias("_last"))
    w = Window.partitionBy("component").orderBy("_day")
    silent = F.col("_first") - F.max("_last").over(w.rowsBetween(Window.unboundedPreceding, -1)) > p.ACTIVE_H * 3600
    days = days.withColumn("_cut", F.coalesce(silent, F.lit(False)).cast("int")).select("component", "_day", F.sum("_cut").over(w).alias("stretch"))
    return rows.join(days, ["component", "_day"]).drop("_day")


def clustered(detections: DataFrame) -> DataFrame:
    """uid, cluster (after all merges; null if unattached), outcome, of each detection; of repeated uids the first arrived counts.

    Rows without a place, time or known source take no part.  Attach-only sources never seed.
    """
    d = detections.select(*ORDER, "acq_s", "lat", "lon", link_distance_km().alias("eps_km"), F.col("source").isin(p.ATTACH_ONLY).alias("coarse")).dropna()
    d = d.groupBy("uid").agg(F.min(F.struct(*[c for c in ORDER if c != "uid"], "acq_s", "lat", "lon", "eps_km", "coarse")).alias("r")).select("uid", "r.*")
    row, column = F.floor(F.col("lat") * CELLS).cast("int"), F.floor(F.col("lon") * CELLS).cast("int")
    d = d.withColumns({"_row": row, "_column": column, "node": row.cast("long") * 100_000 + column})
    cells = d.select("_row", "_column", "node").distinct()
    around = cells.select(F.col("node").alias("a"), F.explode(F.sequence(F.col("_row") - 1, F.col("_row") + 1)).alias("_r"), "_column").select("a", "_r", F.explode(F.sequence(F.col("_column") - 1, F.col("_column") + 1)).alias("_c"))
    edges = around.select("a", (F.col("_r").cast("long") * 100_000 + F.col("_c")).alias("b")).join(cells.select(F.col("node").alias("b")), "b", "left_semi").filter("a != b")
    parts = smallest_reachable(cells.select("node"), edges).withColumnRenamed("root", "component")
    ordered = stretches(d.join(parts, "node")).repartition("component", "stretch").sortWithinPartitions("component", "stretch", *ORDER)
    steps = ordered.select(F.struct("component", "stretch").alias("part"), "uid", "acq_s", "available_s", "lat", "lon", "eps_km", "coarse").mapInPandas(_streamed, _OUT).checkpoint()
    ends = closure(steps.filter("outcome = 'merged'").select("gone", "cluster"), "gone", "cluster")
    own = steps.filter("outcome != 'merged'").select("uid", F.col("cluster").alias("alias"), "outcome")
    return own.join(ends, "alias", "left").select("uid", F.coalesce("canonical", "alias").alias("cluster"), "outcome")
