import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators import density, nearest
from tallyforge.operators.components import connected_components
from tallyforge.operators.imbalance import adasyn, smote


def points(n, d, copies=0, digits=2, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, d)).round(digits)
    x[:copies] = x[0]
    return x


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "key long, features array<double>")


@pytest.mark.parametrize("d,copies,metric", [(1, 0, "euclidean"), (2, 300, "euclidean"), (3, 0, "manhattan")])
def test_nearest_equals_brute_force(spark, d, copies, metric):
    x = points(900, d, copies)
    full = nearest.distances(x, x, metric)
    np.fill_diagonal(full, np.inf)
    found = {}
    for r in nearest.nearest(frame(spark, x), 4, metric=metric).orderBy("query", "rank").collect():
        found.setdefault(r["query"], []).append((r.neighbour, r.distance))
    for i in range(len(x)):
        order = np.lexsort((np.arange(len(x)), full[i]))[:4]
        assert found[i] == [(int(j), float(full[i, j])) for j in order]


@pytest.mark.parametrize("coarse", [0.25, 0.0])
def test_small_cells_of_both_levels(spark, monkeypatch, coarse):
    """Sixty cells below eight tops, or the tops as cells; clusters, ties and far queries."""
    monkeypatch.setattr(nearest, "CELL_ROWS", 10)
    monkeypatch.setattr(nearest, "BLOCK", 16)
    monkeypatch.setattr(nearest, "GROUP", 2)
    monkeypatch.setattr(nearest, "COARSE_SHARE", coarse)
    x = np.concatenate([points(300, 2), points(300, 2, seed=2) * 0.2 + 9]).round(1)
    asked = np.concatenate([x[::7] + 0.05, [[50.0, -50.0], [4.5, 4.5]]])
    d = nearest.distances(asked, x, "euclidean")
    queries = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(asked)], "key long, features array<double>")
    found = {}
    for r in nearest.nearest(frame(spark, x), 6, queries).orderBy("query", "rank").collect():
        found.setdefault(r["query"], []).append((r.neighbour, r.distance))
    for i in range(len(asked)):
        assert found[i] == [(int(j), float(d[i, j])) for j in np.lexsort((np.arange(len(x)), d[i]))[:6]]


def test_reported_rows_stay_near_the_results(spark):
    """What tasks report grows with the rows, not with the cells that are visited."""
    for n in (2000, 8000):
        x = points(n, 2, digits=6)
        sites = frame(spark, x).select(F.col("key").alias("site"), F.col("features").alias("x"))
        places = frame(spark, x).select("key", F.col("features").alias("x"))
        assert nearest.Cells(places, "euclidean").pivots.shape[0] == -(-n // nearest.CELL_ROWS)
        assert nearest._candidates(places, sites, 6, "euclidean").count() <= 2.5 * 6 * n


def test_cosine_distance(spark):
    x = points(200, 4)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    full = 1.0 - unit @ unit.T
    np.fill_diagonal(full, np.inf)
    for r in nearest.nearest(frame(spark, x), 1, metric="cosine").collect():
        assert r.distance == pytest.approx(full[r["query"]].min(), abs=1e-9)


def test_fewer_points_than_asked(spark):
    x = points(3, 2)
    assert nearest.nearest(frame(spark, x), 5).count() == 6


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 99), (200, 150), (150, 180)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.root for r in connected_components(df).collect()}
    assert {found[i] for i in range(61)} == {0}
    assert {found[i] for i in (99, 100, 101)} == {99}
    assert {found[i] for i in (150, 180, 200)} == {150}


def brute_dbscan(x, eps, least, metric):
    near = nearest.distances(x, x, metric) <= eps
    core = near.sum(axis=1) >= least
    label = np.full(len(x), -1)
    number = 0
    for i in range(len(x)):
        if not core[i] or label[i] >= 0:
            continue
        stack = [i]
        while stack:
            j = stack.pop()
            if label[j] < 0:
                label[j] = number
                if core[j]:
                    stack += [int(k) for k in np.flatnonzero(near[j]) if label[k] < 0]
        number += 1
    return label, core


@pytest.mark.parametrize("eps,least,copies,metric", [
    (0.15, 5, 0, "euclidean"), (0.1, 4, 250, "euclidean"), (0.2, 6, 0, "manhattan"), (0.001, 5, 0, "euclidean")])
def test_dbscan_equals_brute_force(spark, eps, least, copies, metric):
    x = points(700, 2, copies)
    label, core = brute_dbscan(x, eps, least, metric)
    found = {r.key: (r.cluster, r.is_core) for r in density.dbscan(
        frame(spark, x), eps=eps, min_samples=least, metric=metric).collect()}
    assert [found[i] for i in range(len(x))] == [(int(a), int(b)) for a, b in zip(label, core)]


def test_synthetic_rows_lie_between_minority_rows(spark):
    x = points(220, 3)
    df = frame(spark, x).withColumn("label", (F.col("key") < 40).cast("int"))
    made = smote(df).collect()
    assert len(made) == 140
    for r in made:
        a, b, p = x[r.source], x[r.neighbour], np.array(r.features)
        assert r.source < 40 and r.neighbour < 40 and r.label == 1
        assert np.linalg.norm(p - a) + np.linalg.norm(p - b) == pytest.approx(np.linalg.norm(a - b))
    assert abs(adasyn(df).count() - 140) <= 40


@pytest.mark.parametrize("scale,shift", [(1.0, 0.0), (1e-3, 1e4), (1e20, 0.0)])
def test_many_dimensions_are_exact_and_not_measured_pair_by_pair(spark, monkeypatch, scale, shift):
    """Copies, ties, numbers far from zero and numbers too large for the products; the same rows as brute force."""
    monkeypatch.setattr(nearest, "WHOLE_BLOCK", 64)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 24)) * scale + shift
    x[300:330] = x[:30]
    x[330:350, 1:] = x[30:50, 1:]
    full = nearest.distances(x, x, "euclidean")
    np.fill_diagonal(full, np.inf)
    found = {}
    for r in nearest.nearest(frame(spark, x), 4).orderBy("query", "rank").collect():
        found.setdefault(r.query, []).append((r.distance, r.neighbour))
    for i in range(len(x)):
        order = np.lexsort((np.arange(len(x)), full[i]))[:4]
        assert found[i] == [(full[i, j], j) for j in order]
    exact = []
    monkeypatch.setattr(nearest, "_paired", lambda q, p, metric, whole=nearest._paired: exact.append(len(q)) or whole(q, p, metric))
    row, col, d = nearest._closest(x, np.full(len(x), np.inf), x, 5, "euclidean")
    assert scale > 1e10 or sum(exact) < 20 * len(x)


def test_lists_of_cells_stay_small(spark):
    """Cells to visit grow with the table; a batch of queries does not hold them all with their temporaries."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(2)
    cells = nearest.Cells.__new__(nearest.Cells)
    cells.metric, cells.coarse = "euclidean", False
    cells._tree(rng.random((16_000, 2)))
    cells.reach, cells.reach_top = np.full(16_000, 0.01), np.full(len(cells.tops), 1.0)
    x, bounds = rng.random((8192, 2)), pd.Series(np.full(8192, 0.15))
    visited, number = (f.func for f in cells._visited())
    peaks, found = [], []
    for run in (visited, number):
        tracemalloc.start()
        found.append(run(pd.Series(list(x)), bounds))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert max(peaks) < 100e6  # 331 and 295 MB when a batch was one list
    assert [len(v) for v in found[0]] == found[1].cells.tolist()
    for i in (0, 700, 8191):
        away = np.sqrt(((x[i] - cells.pivots) ** 2).sum(axis=1))
        assert set(np.flatnonzero(away < 0.1599)) <= set(found[0][i]) <= set(np.flatnonzero(away < 0.1601))


def test_silhouette_compares_few_rows_at_once(spark, monkeypatch):
    """Rows times clusters of a whole Arrow batch are never held at once; the parts change no value."""
    from tallyforge.operators import silhouette

    score = silhouette._score

    def bounded(total, mine, held):
        if total.size > 70:
            raise ValueError("too many rows at once")
        return score(total, mine, held)

    df = spark.range(400).select("id", F.array(F.sin("id"), F.cos(F.col("id") * 3)).alias("features"), (F.col("id") % 7).alias("cluster"))
    values = lambda: {r.id: r.silhouette for r in silhouette.silhouette_samples(df, "cluster").collect()}
    want = values()
    monkeypatch.setattr(silhouette, "ROW_NUMBERS", 70, raising=False)
    monkeypatch.setattr(silhouette, "_score", bounded)
    assert values() == pytest.approx(want, abs=1e-12)
