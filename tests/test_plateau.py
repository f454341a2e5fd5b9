"""Plateau selection against a plain version, on grids of one to three dimensions, and at its edges."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from emberline.operators import plateau

SCHEMA = "slice string, index array<int>, events long, f1 double, meets boolean"


def plain(cells, events, f1):
    """[(slice, cells, width, centre)], widest first."""
    at = {(s, i): (n, g, m) for s, i, n, g, m in cells}

    def next_to(s, i):
        return [(s, j) for d in range(len(i)) for step in (-1, 1) if (s, j := i[:d] + (i[d] + step,) + i[d + 1 :]) in at]

    def stable(a, b):
        (n, g, _), (m, h, _) = at[a], at[b]
        return (m == 0 if n == 0 else abs(m - n) <= events * n + 1e-9) and g is not None and h is not None and abs(g - h) <= f1 + 1e-9

    good = {k for k in at if at[k][2] and all(stable(k, o) for o in next_to(*k))}

    def depth(s, i):
        r = 0
        while all((s, tuple(a + b for a, b in zip(i, step, strict=True))) in good for step in product(range(-r - 1, r + 2), repeat=len(i))):
            r += 1
        return r

    left, found = set(good), []
    while left:
        part, todo = set(), [left.pop()]
        while todo:
            k = todo.pop()
            part.add(k)
            for o in next_to(*k):
                if o in left:
                    left.remove(o)
                    todo.append(o)
        width = max(depth(*k) for k in part)
        sums = [sum(c) for c in zip(*[i for _, i in part], strict=True)]
        centre = min(((sum((len(part) * v - t) ** 2 for v, t in zip(i, sums, strict=True)), i) for s, i in part if depth(s, i) == width))[1]
        found.append((-width, -len(part), min(part)[0], min(i for _, i in part), centre))
    return [(s, -n, -w, c) for w, n, s, _, c in sorted(found)]


def rows_of(df):
    return [(r["slice"], r["cells"], r["width"], tuple(r["centre"])) for r in df.orderBy("place").collect()]


@pytest.mark.parametrize("shape", [(9,), (7, 6), (5, 5, 4)])
def test_against_a_plain_version(spark, shape):
    rng = random.Random(sum(shape))
    cells = []
    for s in ("a", "b"):
        for i in product(*map(range, shape)):
            odd = rng.random()
            cells.append((s, i, 0 if odd < 0.02 else 100 + rng.randrange(3) if odd < 0.93 else 160, None if odd > 0.98 else 0.8, odd < 0.97))
    want = plain(cells, 0.1, 0.05)
    assert want and rows_of(plateau.plateaus(spark.createDataFrame([(s, list(i), n, g, m) for s, i, n, g, m in cells], SCHEMA), len(shape), 0.1, 0.05)) == want


def test_what_breaks_stability_is_named(spark):
    cells = spark.createDataFrame([("s", [0], 0, 0.5, True), ("s", [1], 0, 0.5, True), ("s", [2], 10, 0.5, True), ("s", [3], 11, None, True), ("s", [5], 9, 0.5, True), ("s", [6], 9, 0.5, False)], SCHEMA)
    got = {r["index"][0]: (r["broke"], r["acceptable"]) for r in plateau.judged(cells, 1, 0.2, 0.1).collect()}
    assert got == {0: ([], True), 1: ([[2]], False), 2: ([[1], [3]], False), 3: ([[2]], False), 5: ([], True), 6: ([], False)}


def test_no_cell_and_wrong_cells(spark):
    none = spark.createDataFrame([("s", [0, 0], 1, 0.5, False)], SCHEMA)
    assert rows_of(plateau.plateaus(none, 2, 0.1, 0.1)) == [] == rows_of(plateau.plateaus(none.limit(0), 2, 0.1, 0.1))
    for wrong in (none.unionByName(none), none.withColumn("index", F.array(F.lit(1))), none.withColumn("index", F.array(F.lit(1), F.lit(-1)))):
        with pytest.raises(ValueError, match="cell"):
            plateau.plateaus(wrong, 2, 0.1, 0.1)
