"""Rings of outlines: holes filled, borders traced, vertices thinned; and rings assembled from pieces that share their ends.

The cells of one outline meet in one group, which its own extent bounds; the filling and closing before it are joins
(``operators.outline``).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Vertex = tuple[int, int]


def without_holes(grid: np.ndarray) -> np.ndarray:
    """The cells that the outside can't reach by sides."""
    wall = np.pad(grid.astype(bool), 1)
    outside = np.zeros_like(wall)
    outside[0] = outside[-1] = outside[:, 0] = outside[:, -1] = True
    while True:
        grown = outside.copy()
        grown[1:] |= outside[:-1]
        grown[:-1] |= outside[1:]
        grown[:, 1:] |= outside[:, :-1]
        grown[:, :-1] |= outside[:, 1:]
        grown &= ~wall
        if (grown == outside).all():
            return ~outside[1:-1, 1:-1]
        outside = grown


def traced(grid: np.ndarray) -> list[list[Vertex]]:
    """Rings (x, y) round the cells, against the clock, longest first; where two cells touch at a corner only, they stay apart."""
    cells = np.pad(grid.astype(bool), 1)
    after: dict[Vertex, list[Vertex]] = defaultdict(list)
    # Each free side of a cell, with the cell on its left.
    for (dr, dc), (a, b) in {(-1, 0): ((0, 0), (1, 0)), (0, 1): ((1, 0), (1, 1)), (1, 0): ((1, 1), (0, 1)), (0, -1): ((0, 1), (0, 0))}.items():
        for r, c in np.argwhere(cells & ~np.roll(cells, (-dr, -dc), (0, 1))).tolist():
            after[c - 1 + a[0], r - 1 + a[1]].append((c - 1 + b[0], r - 1 + b[1]))
    rings = []
    for start in sorted(after):
        while after[start]:
            ring, at = [start], after[start].pop()
            while at != start:
                was = ring[-1]
                ring.append(at)
                options = after[at]
                # Of two ways on, the left turn goes round the same cell.
                turn = lambda to, at=at, was=was: (at[0] - was[0]) * (to[1] - at[1]) - (at[1] - was[1]) * (to[0] - at[0])
                at = options.pop(max(range(len(options)), key=lambda i: turn(options[i])))
            rings.append(ring)
    return sorted(rings, key=lambda r: (-len(r), r))


def _furthest(points: np.ndarray) -> tuple[int, float]:
    """The point that lies furthest from the line between the ends, and how far."""
    a, d = points[0], points[-1] - points[0]
    long = float(np.hypot(*d))
    off = points[1:-1] - a
    far = np.abs(off[:, 0] * d[1] - off[:, 1] * d[0]) / long if long else np.hypot(off[:, 0], off[:, 1])
    at = int(np.argmax(far))
    return at + 1, float(far[at])


def simplified(ring: list[Vertex], tolerance: float) -> list[Vertex]:
    """A closed ring with vertices left out that lie within the tolerance of what stays; halves are cut at the vertex furthest from the first."""
    if len(ring) < 4:
        return ring
    points = np.array([*ring, ring[0]], dtype=float)
    opposite = int(np.argmax(np.hypot(*(points[:-1] - points[0]).T)))
    keep, open_ = {0, opposite}, [(0, opposite), (opposite, len(ring))]
    while open_:
        i, j = open_.pop()
        if j - i > 1:
            at, far = _furthest(points[i : j + 1])
            if far > tolerance:
                keep.add(i + at)
                open_ += [(i, i + at), (i + at, j)]
    return [ring[i] for i in sorted(keep)]


def assembled(ways: list[list[Vertex]]) -> tuple[list[list[Vertex]], int]:
    """Rings of pieces joined where their ends meet, in the order given, and how many chains stay open."""
    left, rings, unclosed = [list(w) for w in ways if len(w) > 1], [], 0
    while left:
        chain = left.pop(0)
        while chain[0] != chain[-1]:
            at = next((i for i, w in enumerate(left) if chain[-1] in (w[0], w[-1])), None)
            if at is None:
                unclosed += 1
                break
            way = left.pop(at)
            chain += (way if way[0] == chain[-1] else way[::-1])[1:]
        else:
            rings.append(chain[:-1])
    return rings, unclosed


def outline_rings(cells: DataFrame, key: str, tolerance: float) -> DataFrame:
    """key, ring (its number, longest first), border, doubled_area, vertices (x, y in cells) of each ring of cells (key, r, c)."""
    kind = dict(cells.dtypes)[key]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(group["r"].min()), int(group["c"].min())
        grid = np.zeros((int(group["r"].max()) - r0 + 1, int(group["c"].max()) - c0 + 1), dtype=bool)
        grid[group["r"] - r0, group["c"] - c0] = True
        rows = []
        for k, ring in enumerate(traced(without_holes(grid))):
            x, y = np.array(ring).T
            area = int((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())
            rows.append((group[key].iloc[0], k, len(ring), area, [{"x": a + c0, "y": b + r0} for a, b in simplified(ring, tolerance)]))
        return pd.DataFrame(rows, columns=[key, "ring", "border", "doubled_area", "vertices"])

    return cells.select(key, "r", "c").groupBy(key).applyInPandas(run, f"{key} {kind}, ring int, border long, doubled_area long, vertices array<struct<x: long, y: long>>")


def rings_of_ways(ways: DataFrame, key: str) -> DataFrame:
    """key, rings, unclosed of pieces (key, place, way: array of x, y): a relation's own pieces meet in one row."""
    kind = dict(ways.dtypes)[key]
    rings_type = pa.list_(pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [assembled([list(zip(a, b, strict=True)) for a, b in zip(xs, ys, strict=True)]) for xs, ys in zip(batch["xs"].to_pylist(), batch["ys"].to_pylist(), strict=True)]
            rings = pa.array([[[{"x": x, "y": y} for x, y in ring] for ring in own] for own, _ in found], rings_type)
            yield pa.RecordBatch.from_arrays([batch[key], rings, pa.array([n for _, n in found], pa.int32())], names=[key, "rings", "unclosed"])

    own = ways.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("place").isNull().alias("last"), "place", "way"))).alias("own"))
    flat = own.select(key, F.transform("own", lambda w: F.transform(w["way"], lambda v: v["x"].cast("long"))).alias("xs"), F.transform("own", lambda w: F.transform(w["way"], lambda v: v["y"].cast("long"))).alias("ys"))
    return flat.mapInArrow(run, f"{key} {kind}, rings array<array<struct<x: long, y: long>>>, unclosed int")
