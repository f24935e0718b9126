"""Whitening against exact whole-number covariances."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from namesmith.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n string, vector string"


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(i, v, 1, "c", "n", "v") for i, v in zip(ids or range(len(vectors)), vectors, strict=True)], SCHEMA).repartition(3)


def made(n, dim, seed=3):
    rng = np.random.default_rng(seed)
    return [[float(np.float32(x)) for x in row] for row in rng.normal(size=(n, dim)) * np.linspace(1, 0.2, dim) + rng.normal(size=dim)]


def exact(vectors):
    x = np.array([[int(np.floor(1024.0 * c)) + 100_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    v = n * (x.T @ x) - np.outer(s, s)
    return x, s, np.array([[np.longdouble(int(c)) for c in row] for row in v]) / np.longdouble(n) / np.longdouble(n)


def test_against_whole_numbers(spark):
    vectors = made(700, 12)
    x, s, v = exact(vectors)
    n = len(x)
    rows = table(spark, vectors)
    got = whitening.whitened(rows).collect()
    assert len(got) == 8 * n
    values, vecs = np.linalg.eigh(v.astype(float))
    values, vecs = values[::-1][:8], vecs[:, ::-1][:, :8]
    want = (x - s / n).astype(float) @ vecs / np.sqrt(values)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    z = np.zeros((n, 8))
    for r in got:
        assert r.n == n and r.deviation == deviation[r.vec_id]
        assert abs(r.explained / (values[r.component - 1] / np.trace(v)) - 1) < 1e-12
        assert r.identity_error < 1e-9
        z[r.vec_id, r.component - 1] = r.whitened
    assert np.abs(np.abs(z) - np.abs(want)).max() < 1e-9
    assert np.abs(z.T @ z / n - np.eye(8)).max() < 1e-9


@pytest.mark.parametrize("far", [0.0, 5e7])
def test_covariance_keeps_more_than_a_double(spark, far):
    """A spread of 1 about a mean of 5e7 loses nothing."""
    vectors = [[x + far for x in v] for v in made(300, 5)]
    rows = spark.createDataFrame([(v,) for v in vectors], "vector array<double>").repartition(4)
    x, s, v = exact(vectors)
    got = whitening.covariance(rows, *whitening.moments(rows))
    assert float(np.abs(got - v).max() / np.abs(v).max()) < 1e-17


def test_parts_merge_in_any_number(spark):
    vectors = made(400, 6)
    one, many = (whitening.covariance(r, *whitening.moments(r)) for r in (spark.createDataFrame([(v,) for v in vectors], "vector array<double>").repartition(p) for p in (1, 50)))
    assert float(np.abs(one - many).max() / np.abs(one).max()) < 1e-18


def test_unusable_rows(spark):
    good = made(60, 4)
    odd = [None, [], [1.0, None, 2.0, 3.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0], [1e30, 0.0, 0.0, 0.0], [1.0, 2.0]]
    mixed = table(spark, good + odd)
    plain = table(spark, good)
    got, want = (sorted((r.vec_id, r.component, r.deviation, r.n) for r in whitening.whitened(x).collect()) for x in (mixed, plain))
    assert got == want and len(got) == 60 * 4


def test_repeated_rows_ties_and_no_variance(spark):
    good = made(30, 3)
    got = whitening.whitened(table(spark, good + good, [*range(30)] * 2)).collect()
    assert len(got) == 60 * 3 and {r.n for r in got} == {60}
    assert whitening.whitened(table(spark, [[1.0, 2.0]] * 5)).collect() == []
    flat = whitening.whitened(table(spark, [[a, 7.0] for a in (1.0, 2.0, 4.0)])).collect()
    assert {r.component for r in flat} == {1} and {round(r.explained, 12) for r in flat} == {1.0}
    assert whitening.whitened(table(spark, good).limit(0)).collect() == []
    assert whitening.whitened(table(spark, [[0.5, 1.5]])).collect() == []


def test_equal_eigenvalues(spark):
    square = [[a, b] for a in (0.0, 8.0) for b in (0.0, 8.0)] * 3
    got = whitening.whitened(table(spark, square)).collect()
    assert len(got) == 24 and {round(r.explained, 12) for r in got} == {0.5} and all(r.identity_error < 1e-12 for r in got)


def test_deviation_beyond_64_bits(spark):
    rng = random.Random(1)
    got = whitening.whitened(table(spark, [[rng.choice((-1e8, 1e8)), rng.random()] for _ in range(40)])).collect()
    assert {r.deviation for r in got} == {None}


def test_other_columns_are_ignored(spark):
    assert whitening.whitened(table(spark, made(20, 3)).withColumn("whitened", F.lit("x"))).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
