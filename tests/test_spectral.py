"""Spectral clustering on shapes that no centre separates."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tallyforge.operators import clustering


def rings(rng, n=80):
    angle = np.linspace(0, 2 * np.pi, n, endpoint=False)
    shapes = [r * np.stack([np.cos(angle), np.sin(angle)], axis=1) for r in (1.0, 3.0, 5.0)]
    return np.concatenate(shapes) + rng.normal(scale=0.05, size=(3 * n, 2)), np.repeat([0, 1, 2], n)


def chains(rng, n=70):
    """Two half moons that reach into each other."""
    angle = np.linspace(0, np.pi, n)
    upper = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    lower = np.stack([1 - np.cos(angle), 0.4 - np.sin(angle)], axis=1)
    return np.concatenate([upper, lower]) * 3 + rng.normal(scale=0.05, size=(2 * n, 2)), np.repeat([0, 1], n)


@pytest.mark.parametrize("shape,k", [(rings, 3), (chains, 2)])
def test_planted_shapes_are_split(spark, shape, k):
    x, truth = shape(np.random.default_rng(4))
    df = spark.createDataFrame([(i, int(t), [float(v) for v in r]) for i, (r, t) in enumerate(zip(x, truth))], "key long, truth int, x array<double>")
    out = clustering.spectral(df.withColumn("features", array_to_vector("x")), k, neighbours=6)
    groups = out.groupBy("truth").agg(F.countDistinct("cluster").alias("n"), F.min("cluster").alias("c")).collect()
    assert all(g.n == 1 for g in groups) and len({g.c for g in groups}) == k


def test_leading_vectors_are_eigenvectors(spark):
    """A graph of three loose groups: the span of the vectors is that of the dense decomposition."""
    rng = np.random.default_rng(5)
    n = 60
    w = rng.random((n, n)) * (rng.random((n, n)) < 0.5) * np.where(np.arange(n)[:, None] % 3 == np.arange(n)[None] % 3, 1.0, 0.03)
    w = np.triu(w, 1)
    w = w + w.T + np.diag(np.full(n - 1, 0.01), 1) + np.diag(np.full(n - 1, 0.01), -1)
    edges = spark.createDataFrame([(int(a), int(b), float(w[a, b])) for a, b in np.argwhere(w > 0)], "a long, b long, w double")
    rows = {r.node: r.v for r in clustering.leading_vectors(edges, 3, precision=1e-8).collect()}
    got = np.array([rows[i] for i in range(n)])
    d = w.sum(axis=1)
    _, axes = np.linalg.eigh(w / np.sqrt(d[:, None] * d[None]))
    want = axes[:, ::-1][:, :3]
    np.testing.assert_allclose(np.abs(np.diag(want.T @ got)), 1.0, atol=1e-6)


def test_neighbours_are_searched_once(spark, monkeypatch):
    """The multiplications start from stored affinities, whose plan holds no search."""
    given, vectors = [], clustering.leading_vectors
    monkeypatch.setattr(clustering, "leading_vectors", lambda edges, *more: given.append(edges) or vectors(edges, *more))
    x, _ = rings(np.random.default_rng(4), 30)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "key long, x array<double>")
    clustering.spectral(df.select("key", array_to_vector("x").alias("features")), 3, neighbours=6, rounds=1)
    plan = given[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Window" not in plan
