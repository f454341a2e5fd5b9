"""Whitening against numpy's eigen-solve and exact integers; rows that are no vectors."""

import math
from decimal import Decimal

import numpy as np
import pytest

from emberline.llm import queries as q
from emberline.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, sums string, n double"


def whole(vectors):
    return [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]


@pytest.mark.parametrize("n", [1, 2, 3, 10, 40])
def test_symmetric_qr(n):
    a = np.random.default_rng(n).normal(size=(n, n))
    for m in (a + a.T, a @ a.T, np.diag(np.arange(n, dtype=float)), np.ones((n, n)), np.zeros((n, n)), 1e12 * (a + a.T)):
        values, vectors = whitening.symmetric_qr(m)
        size = max(1.0, np.abs(m).max())
        assert np.allclose(values, np.linalg.eigvalsh(m)[::-1], atol=1e-12 * n * size)
        assert np.allclose(vectors @ np.diag(values) @ vectors.T, m, atol=1e-12 * n * size)
        assert np.allclose(vectors.T @ vectors, np.eye(n), atol=1e-12 * n)


def test_moments_stream_and_merge_alike():
    x = np.random.default_rng(0).integers(-5, 6, size=(500, 6)) + 1_000_000
    total = whitening.Moments(6)
    for part in np.split(x, [0, 1, 17, 17, 250]):
        own = whitening.Moments(6)
        for batch in np.array_split(part, 4):
            own.add(batch)
        total.merge(own)
    centred = x - x.mean(axis=0)
    assert total.n == 500 and total.sums().tolist() == x.sum(axis=0).tolist()
    assert np.allclose(total.scatter, centred.T @ centred, rtol=1e-12, atol=1e-8)
    one = whitening.Moments(6)
    for row in x:
        one.add(row[None])
    assert np.allclose(one.scatter, total.scatter, rtol=1e-12, atol=1e-8)


def test_op11_against_numpy(spark, sf_dir):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    x = whole(rows.values())
    n, d = len(x), len(x[0])
    sums = [sum(c) for c in zip(*x, strict=True)]
    far = dict(zip(rows, [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x], strict=True))
    values, vectors = np.linalg.eigh(np.cov(np.array(x, dtype=float).T, bias=True))
    got = q.op11_embedding_whitening(spark, sf_dir).collect()
    assert len(got) == n * min(32, d)
    white = np.zeros((n, 32))
    at = {v: i for i, v in enumerate(rows)}
    for r in got:
        assert r["n"] == n and r["deviation"] == far[r["vec_id"]] and 0 <= r["identity_error"] <= 1e-4
        assert abs(r["explained"] - values[-r["component"]] / values.sum()) <= 1e-6
        white[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
    assert np.abs(np.cov(white.T, bias=True) - np.eye(32)).max() < 1e-4
    want = (np.array(x) - np.array(sums) / n) @ vectors[:, ::-1][:, :32] / np.sqrt(values[::-1][:32])
    assert np.allclose(np.abs(white), np.abs(want), atol=1e-6)


def test_rows_that_are_no_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.0, 1.0]), (2, [1.0, 0.5]), (2, [1.0, 0.5]), (None, [-3.0, 0.25]), (5, [0.1, -0.1])]
    bad = [(6, None), (7, []), (8, [1.0, None]), (9, [nan, 1.0]), (10, [inf, 1.0]), (11, [-inf, 1.0]), (12, [1.0]), (13, [1.0, 2.0, 3.0]), (14, [1e30, 1.0])]
    rows = spark.createDataFrame([(*r, "clash", 0.0) for r in good + bad], SCHEMA)
    got = whitening.whiten(rows).collect()
    x = np.array(whole([v for _, v in good]))
    s = x.sum(axis=0)
    assert sorted(((r["vec_id"], r["component"]) for r in got), key=str) == sorted(((i, c) for i, _ in good for c in (1, 2)), key=str)
    assert {r["deviation"] for r in got if r["vec_id"] is None} == {int(((5 * x[3] - s) ** 2).sum())}
    assert all(r["n"] == 5 and r["identity_error"] < 1e-9 for r in got)
    assert sum({r["component"]: r["explained"] for r in got}.values()) == pytest.approx(1)
    for few in (rows.limit(0), rows.filter("vec_id > 5"), rows.filter("vec_id = 1"), rows.filter("vec_id = 2")):
        assert whitening.whiten(few).collect() == [] and whitening.whiten(few).columns == whitening.whiten(rows).columns


def test_directions_without_variance_are_left_out(spark):
    rows = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0], "", 0.0) for i in range(10)], SCHEMA)
    got = whitening.whiten(rows).collect()
    assert {r["component"] for r in got} == {1} and got[0]["explained"] == pytest.approx(1)


def test_deviations_beyond_a_long_are_exact(spark):
    rows = spark.createDataFrame([(1, [1e9, 0.0], "", 0.0), (2, [-1e9, 0.0], "", 0.0), (3, [0.0, 1.0], "", 0.0)], SCHEMA)
    model = whitening.fit(rows, 2)
    got = {r["vec_id"]: r["deviation"] for r in whitening.transform(rows, model).collect()}
    x = whole([[1e9, 0.0], [-1e9, 0.0], [0.0, 1.0]])
    s = [sum(c) for c in zip(*x, strict=True)]
    assert got == {i + 1: Decimal(sum((3 * c - t) ** 2 for c, t in zip(v, s, strict=True))) for i, v in enumerate(x)}
    assert max(got.values()) > 2**63


def test_many_partitions_merge_in_a_tree(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, rng.normal(size=3).tolist(), "", 0.0) for i in range(200)], SCHEMA)
    one, many = (whitening.fit(rows.repartition(p), 3) for p in (1, 40))
    assert one.sums.tolist() == many.sums.tolist() and np.allclose(one.values, many.values, rtol=1e-12)
