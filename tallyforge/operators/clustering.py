"""Clustering: k-means, and methods that work on a bounded set of weighted micro-clusters."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.hashing import hash_unit
from tallyforge.operators.nearest import distances, nearest
from tallyforge.operators.ordering import positions
from tallyforge.session import BROADCAST_BYTES, BROADCAST_ROWS, materialise, spread

SEED = 42
# Micro-clusters handed to the quadratic methods.
MICRO = 500
# Rows beyond which mean shift spreads the table before its first step, and rows it compares at once.
SPREAD_ROWS = 100_000
ROWS_AT_ONCE = 512


def kmeans(df: DataFrame, k: int, init: str = "k-means||", starts: int = 10, seed: int = SEED):
    """The run with the smallest within-cluster sum out of several starts."""
    table = df.select("features").persist()
    one = lambda s: KMeans(k=k, initMode=init, seed=s).fit(table)
    with ThreadPoolExecutor(4) as pool:
        models = list(pool.map(one, range(seed, seed + starts)))
    table.unpersist()
    return min(models, key=lambda m: m.summary.trainingCost)


def with_kmeans(df: DataFrame, k: int, **options) -> DataFrame:
    model = kmeans(df, k, **options)
    return model.transform(df).withColumnRenamed("prediction", "cluster")


def micro_clusters(df: DataFrame, limit: int = MICRO):
    """Centres and weights of at most ``limit`` micro-clusters, and the rows with their number; the
    same k-means step at every size of the table."""
    model = KMeans(k=limit, seed=SEED, maxIter=10).fit(df)
    rows = model.transform(df).withColumnRenamed("prediction", "micro")
    sizes = {r.micro: r.n for r in rows.groupBy("micro").agg(F.count("*").alias("n")).collect()}
    centres = np.array(model.clusterCenters())
    return centres, np.array([sizes.get(i, 0) for i in range(len(centres))], dtype=float), rows


def _with_labels(rows: DataFrame, labels) -> DataFrame:
    """Cluster of each row from the cluster of its micro-cluster (at most ``MICRO`` entries)."""
    table = rows.sparkSession.createDataFrame(
        [(i, int(v)) for i, v in enumerate(labels)], "micro int, cluster int")
    return rows.join(F.broadcast(table), "micro").drop("micro")


def _renumber(labels: np.ndarray) -> np.ndarray:
    first = {}
    for v in labels:
        first.setdefault(v, len(first))
    return np.array([first[v] for v in labels])


def _merge(centres: np.ndarray, weights: np.ndarray, k: int, linkage: str) -> np.ndarray:
    """Agglomeration of weighted centres by the Lance-Williams update."""
    n = len(centres)
    size = weights.copy()
    size[size == 0] = 1e-9
    d = distances(centres, centres, "euclidean")
    if linkage == "ward":
        d = d ** 2 * (2.0 * size[:, None] * size[None, :] / (size[:, None] + size[None, :]))
    np.fill_diagonal(d, np.inf)
    group = np.arange(n)
    for _ in range(n - k):
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        a, b = size[i], size[j]
        if linkage == "ward":
            total = a + b + size
            new = ((a + size) * d[i] + (b + size) * d[j] - size * d[i, j]) / total
        elif linkage == "average":
            new = (a * d[i] + b * d[j]) / (a + b)
        else:
            new = np.maximum(d[i], d[j])
        new[i] = new[j] = np.inf
        new[np.isinf(d[i])] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] = a + b
        group[group == j] = i
    return _renumber(group)


def hierarchical(df: DataFrame, k: int, linkage: str = "ward", limit: int = MICRO) -> DataFrame:
    """Bottom-up clustering: rows to micro-clusters in Spark, then merging of the small table."""
    centres, weights, rows = micro_clusters(df, limit)
    return _with_labels(rows, _merge(centres, weights, min(k, len(centres)), linkage))


def estimate_bandwidth(centres: np.ndarray, weights: np.ndarray, quantile: float = 0.3) -> float:
    """Mean distance to the neighbour at a quantile of all rows, over weighted centres."""
    d = distances(centres, centres, "euclidean")
    order = np.argsort(d, axis=1)
    reached = np.cumsum(weights[order], axis=1) >= quantile * weights.sum()
    at = reached.argmax(axis=1)
    row = np.arange(len(d))
    return float(np.average(d[row, order[row, at]], weights=np.maximum(weights, 1e-9)))


def mean_shift(df: DataFrame, bandwidth: float | None = None, limit: int = MICRO, rounds: int = 50) -> DataFrame:
    """Seeds climb to the mean of the rows within the bandwidth; rows join the nearest peak.

    Each round adds up the rows around every seed inside the partitions; one row per seed and
    partition is shuffled. A table of more than ``SPREAD_ROWS`` rows is spread over all cores first,
    as every step passes over it many times.
    """
    if df.limit(SPREAD_ROWS + 1).count() > SPREAD_ROWS:
        df = materialise(spread(df, "key"))
    centres, weights, rows = micro_clusters(df, limit)
    bandwidth = bandwidth or estimate_bandwidth(centres, weights)
    points = df.select(vector_to_array("features").alias("x")).persist()
    seeds, width = centres.copy(), centres.shape[1]

    def round_sums(at: np.ndarray):
        def sums(batches):
            total, held = np.zeros((len(at), width)), np.zeros(len(at))
            for batch in batches:
                every = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                for i in range(0, len(every), ROWS_AT_ONCE):  # the distances stay in the processor's cache
                    x = every[i:i + ROWS_AT_ONCE]
                    near = distances(at, x, "euclidean") <= bandwidth
                    total += near @ x
                    held += np.count_nonzero(near, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(at)), pa.int32()), pa.array(held),
                                              pa.array(list(total), pa.list_(pa.float64()))], ["seed", "held", "total"])

        merged = points.mapInArrow(sums, "seed int, held double, total array<double>").groupBy("seed").agg(
            F.sum("held").alias("held"), *[F.sum(F.col("total")[j]).alias(f"t{j}") for j in range(width)])
        got = merged.collect()  # one row per seed
        held, mean = np.zeros(len(at)), at.copy()
        for r in got:
            held[r.seed] = r.held
            if r.held > 0:
                mean[r.seed] = [r[f"t{j}"] / r.held for j in range(width)]
        return mean, held

    for _ in range(rounds):
        moved, held = round_sums(seeds)
        step = np.sqrt(((moved - seeds) ** 2).sum(axis=1)).max()
        seeds = moved
        if step < 1e-3 * bandwidth:
            break
    points.unpersist()
    peaks: list[np.ndarray] = []
    for i in sorted(range(len(seeds)), key=lambda i: (-held[i], tuple(seeds[i]))):
        if held[i] > 0 and all(np.sqrt(((seeds[i] - p) ** 2).sum()) > bandwidth for p in peaks):
            peaks.append(seeds[i])
    top = np.array(peaks)

    @F.pandas_udf("int")
    def closest(xs: pd.Series) -> pd.Series:
        return pd.Series(distances(np.vstack(xs.to_numpy()), top, "euclidean").argmin(axis=1).astype("int32"))

    return rows.drop("micro").withColumn("cluster", closest(vector_to_array("features")))


def spectral(df: DataFrame, k: int, key: str = "key", neighbours: int = 10, gamma: float = 1.0,
             rounds: int = 8, precision: float = 5e-4) -> DataFrame:
    """k-means on the leading ``k`` eigenvectors of the normalised nearest-neighbour affinities."""
    pts = df.select(F.col(key).cast("bigint").alias(key), vector_to_array("features").alias("x"))
    near = nearest(pts, neighbours, key=key, features="x")
    weight = F.greatest(F.exp(-F.lit(gamma) * F.col("distance") * F.col("distance")), F.lit(1e-12))
    one = near.select(F.least("query", "neighbour").alias("a"), F.greatest("query", "neighbour").alias("b"), weight.alias("w"))
    one = materialise(one.groupBy("a", "b").agg(F.max("w").alias("w")))  # the search runs once
    both = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    vectors = leading_vectors(both, k, rounds, precision)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, v: s + v * v))
    rows = vectors.select(F.col("node").alias(key), array_to_vector(
        F.transform("v", lambda v: F.when(length > 0, v / length).otherwise(0.0))).alias("features"))
    found = with_kmeans(rows.withColumnRenamed(key, "key"), k, starts=8)
    return df.join(found.select(F.col("key").alias(key), "cluster"), key)


def leading_vectors(edges: DataFrame, k: int, rounds: int = 8, precision: float = 5e-4, degree: int = 16) -> DataFrame:
    """``node, v``: the ``k`` eigenvectors of the largest eigenvalues of the symmetric affinities
    ``(a, b, w)``, scaled by the roots of the degrees; both directions of an edge are given.

    Some vectors more than asked for are iterated together. Each round multiplies them ``degree`` times
    in a Chebyshev recurrence that damps all eigenvalues below the smallest one found so far, makes
    them orthogonal by the small matrix of their products, and stops when no wanted vector changes by
    more than ``precision`` under one more multiplication. A multiplication is a join and one sum by
    node; only the matrices of products come to the driver.
    """
    held = materialise(edges.groupBy("a").agg(F.sum("w").alias("d")))
    scaled = edges.join(held, "a").join(held.select(F.col("a").alias("b"), F.col("d").alias("e")), "b")
    graph = materialise(scaled.select("a", "b", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("w")))
    nodes = held.count()
    width = min(k + 2, max(1, nodes))
    # the vectors are sent to the edges where they are small enough, and shuffled to them elsewhere
    send = F.broadcast if nodes <= BROADCAST_ROWS and nodes * (width + 2) * 8 <= BROADCAST_BYTES else (lambda df: df)
    start = [F.sqrt("d")] + [hash_unit("a", f"vector{i}") - 0.5 for i in range(1, width)]
    state = held.select(F.col("a").alias("node"), F.array(*start).alias("v"))
    for turn in range(rounds):
        image = materialise(_step(graph, state, send, width, 0.0, 1.0))
        values, mix, error = _ritz(_products(image, width), min(k, width))
        state = materialise(_combined(image, mix))
        width = mix.shape[1]
        if error <= precision or turn == rounds - 1:
            break
        low = float(np.clip(values[-1], 0.0, 0.999))
        centre, half = (low - 1.0) / 2.0, (low + 1.0) / 2.0
        for step in range(degree):
            made = _step(graph, state, send, width, centre, (1.0 if step == 0 else 2.0) / half)
            state = materialise(made.select("node", F.col("u").alias("v"), F.col("v").alias("p")))
        state = state.select("node", "v")
    return state.select("node", F.slice("v", 1, min(k, width)).alias("v"))


def _step(graph: DataFrame, state: DataFrame, send, width: int, centre: float, factor: float) -> DataFrame:
    """``node, v, u``: with ``u`` the vectors times (graph - centre) * factor, less the vectors ``p``
    before them where the state has such."""
    sent = send(state.select(F.col("node").alias("b"), "v"))
    met = graph.join(sent, "b").select(F.col("a").alias("node"), F.transform("v", lambda v: v * F.col("w") * factor).alias("s"),
                                       F.lit(None).cast("array<double>").alias("v"))
    less = F.transform("v", lambda v: v * (-centre * factor))
    if "p" in state.columns:
        less = F.zip_with(less, "p", lambda a, p: a - p)
    sums = F.array(*[F.sum(F.col("s")[i]) for i in range(width)])
    return met.unionByName(state.select("node", less.alias("s"), "v")).groupBy("node").agg(
        F.first("v", ignorenulls=True).alias("v"), sums.alias("u"))


def _products(image: DataFrame, width: int) -> np.ndarray:
    """The three matrices of products v'v, v'u and u'u, added up inside the tasks."""
    def run(batches):
        total = np.zeros((3, width, width))
        for pdf in batches:
            if len(pdf):
                v, u = np.vstack(pdf["v"].to_numpy()), np.vstack(pdf["u"].to_numpy())
                total += np.stack([v.T @ v, v.T @ u, u.T @ u])
        yield pd.DataFrame({"place": np.arange(total.size), "part": total.ravel()})

    parts = image.select("v", "u").mapInPandas(run, "place int, part double").groupBy("place").agg(F.sum("part").alias("part"))
    out = np.zeros(3 * width * width)
    for r in parts.collect():  # entries of three small matrices
        out[r.place] = r.part
    return out.reshape(3, width, width)


def _ritz(products: np.ndarray, k: int):
    """Falling eigenvalues within the span of the vectors, the combinations that give the eigenvectors,
    and how far the first ``k`` are from being eigenvectors."""
    vv, vu, uu = products
    size, axes = np.linalg.eigh((vv + vv.T) / 2)
    kept = size > 1e-12 * size.max()
    basis = axes[:, kept] / np.sqrt(size[kept])
    values, turn = np.linalg.eigh(basis.T @ (vu + vu.T) @ basis / 2)
    order = np.argsort(-values)
    values, mix = values[order], basis @ turn[:, order]
    rest = np.einsum("ij,jk,ki->i", mix.T, uu, mix) - values ** 2
    return values, mix, float(np.sqrt(np.maximum(rest[:k], 0.0)).max())


def _combined(image: DataFrame, mix: np.ndarray) -> DataFrame:
    @F.pandas_udf("array<double>")
    def combine(vs: pd.Series) -> pd.Series:
        return pd.Series(list(np.vstack(vs.to_numpy()) @ mix) if len(vs) else [], dtype=object)

    return image.select("node", combine("v").alias("v"))


def renumber(df: DataFrame, key: str = "key") -> DataFrame:
    """Clusters numbered by their smallest key."""
    first = df.groupBy("cluster").agg(F.min(key).alias("_first"))
    numbers = positions(first, ["_first"], "_number").select("cluster", "_number")
    return df.join(numbers, "cluster").drop("cluster").withColumnRenamed("_number", "cluster")
