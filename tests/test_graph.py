"""Components of graphs whose labels would take as many rounds as they have nodes, and of random ones."""

import random

import pytest

from emberline.operators.graph import smallest_reachable, stars


def brute(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {x: find(x) for x in root}


def shapes():
    n, rng = 2000, random.Random(1)
    mixed = list(range(n))
    rng.shuffle(mixed)
    yield "falling", [(a, b) for a, b in zip([0, *range(n - 1, 0, -1)], range(n - 1, 0, -1), strict=False)]
    yield "mixed", list(zip(mixed, mixed[1:], strict=False))
    yield "star", [(500, x) for x in range(n) if x != 500]
    yield "tree", [(x, (x - 1) // 2) for x in range(1, n)]
    yield "random", [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)]


@pytest.mark.parametrize(("shape", "edges"), list(shapes()))
def test_components_in_few_rounds(spark, shape, edges):
    rounds = []
    got = stars(spark.createDataFrame(edges, "x long, y long"), rounds)
    assert {r["node"]: r["root"] for r in got.collect()} == {k: v for k, v in brute(edges).items() if any(k in e for e in edges if e[0] != e[1])}
    assert rounds[0] <= 25


def test_nodes_without_edges_are_their_own(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "node string")
    edges = spark.createDataFrame([("c", "b"), ("b", "c"), ("d", "d"), (None, "a")], "a string, b string")
    assert {tuple(r) for r in smallest_reachable(nodes, edges).collect()} == {("a", "a"), ("b", "b"), ("c", "b"), ("d", "d")}
    assert smallest_reachable(nodes.limit(0), edges.limit(0)).collect() == []
