"""Composed business flows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import (
    anomaly, clustering, density, entity, features, isolation, prepare, recommend, segments, timeaxis,
)
from tallyforge.operators.ordering import positions
from tallyforge.operators.profile import row_digest
from tallyforge.operators.silhouette import silhouette
from tallyforge.plans import automl
from tallyforge.session import materialise


# -- clustering ------------------------------------------------------------------------------------

CLUSTERERS = ("kmeans", "dbscan", "hierarchical", "mean_shift", "spectral")
# The candidates searched per clusterer.
CLUSTER_GRIDS = {
    "kmeans": {"k": [2, 3, 4, 5, 6], "init": ["k-means||", "random"]},
    "dbscan": {"eps": [0.3, 0.5, 0.7, 1.0], "min_samples": [3, 5, 7, 10]},
    "hierarchical": {"k": [2, 3, 4, 5, 6], "linkage": ["ward", "complete", "average"]},
}


def cluster(df: DataFrame, name: str, k: int = 4, eps: float = 0.5, min_samples: int = 5,
            metric: str = "euclidean", init: str = "k-means||", linkage: str = "ward", starts: int = 3) -> DataFrame:
    """Adds ``cluster`` to rows with ``key`` and a ``features`` vector."""
    if name == "kmeans":
        return clustering.with_kmeans(df, k, init=init, starts=starts)
    if name == "dbscan":
        from pyspark.ml.functions import vector_to_array

        arrays = df.select("key", vector_to_array("features").alias("features"))
        return df.join(density.dbscan(arrays, eps=eps, min_samples=min_samples, metric=metric).drop("is_core"), "key")
    if name == "hierarchical":
        return clustering.hierarchical(df, k, linkage)
    if name == "mean_shift":
        return clustering.mean_shift(df)
    if name == "spectral":
        return clustering.spectral(df, k)
    raise ValueError(f"no clusterer named {name!r}")


def cluster_metrics(labelled: DataFrame) -> dict:
    """Clusters found, noise rows, and the three quality measures (None below two clusters)."""
    table = labelled.select("cluster", "features").persist()
    sizes = {r.cluster: r.n for r in table.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    out = {"clusters": len([c for c in sizes if c != -1]), "noise": sizes.get(-1, 0),
           "silhouette": None, "davies_bouldin": None, "calinski_harabasz": None}
    if len(sizes) >= 2:
        out.update(silhouette=silhouette(table, "cluster"), davies_bouldin=segments.davies_bouldin(table, "cluster"),
                   calinski_harabasz=segments.calinski_harabasz(table, "cluster"))
    table.unpersist()
    return out


def cluster_leaderboard(df: DataFrame, names, metric: str = "silhouette", **params) -> DataFrame:
    """Every clusterer with its measures, best first; a smaller Davies-Bouldin index is better."""
    rows = []
    for name in names:
        found = cluster_metrics(cluster(df, name, **params))
        value = found[metric]
        order = float("-inf") if value is None else -value if metric == "davies_bouldin" else value
        rows.append((order, name, found))
    rows.sort(key=lambda r: (-r[0], r[1]))
    digits = lambda v: None if v is None else round(float(v), 6)
    return df.sparkSession.createDataFrame(
        [(i + 1, n, f["clusters"], f["noise"], digits(f["silhouette"]), digits(f["davies_bouldin"]), digits(f["calinski_harabasz"]))
         for i, (_, n, f) in enumerate(rows)],
        "rank int, model string, clusters int, noise bigint, silhouette double, davies_bouldin double, calinski_harabasz double")


def tune_clusters(df: DataFrame, name: str, grid: dict | None = None, **fixed) -> list[dict]:
    """Silhouette of every grid point, best first."""
    import itertools

    grid = CLUSTER_GRIDS[name] if grid is None else grid
    tried = []
    for values in itertools.product(*grid.values()):
        params = dict(zip(grid, values))
        found = cluster_metrics(cluster(df, name, **{**fixed, **params}))
        tried.append({**params, "silhouette": found["silhouette"], "clusters": found["clusters"]})
    return sorted(tried, key=lambda r: float("inf") if r["silhouette"] is None else -r["silhouette"])


def elbow(df: DataFrame, largest: int = 6, starts: int = 3) -> DataFrame:
    """Within-cluster sum of squares and silhouette for 2 to ``largest`` clusters."""
    table = df.persist()
    rows = []
    for k in range(2, largest + 1):
        model = clustering.kmeans(table, k, starts=starts)
        labelled = model.transform(table).withColumnRenamed("prediction", "cluster")
        rows.append((k, round(model.summary.trainingCost, 6), round(silhouette(labelled, "cluster"), 6)))
    table.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double")


def automl_cluster(df: DataFrame, key: str, numeric: list[str] | None = None, largest: int = 10) -> DataFrame:
    """The automatic clustering run: numeric columns imputed and scaled, every number of clusters from
    2 to ``largest`` tried by k-means, the one of the best silhouette taken.

    Returns the rows with ``cluster`` and, on each, the chosen ``k`` and its ``silhouette``.
    """
    numeric = numeric or features.select_numeric(df, [key])
    filled = prepare.impute_robust(df, numeric)
    scaled = prepare.Scaler.fit(filled, numeric).transform(filled)
    ready = materialise(scaled.select(F.col(key).alias("key"), array_to_vector(F.array(*numeric)).alias("features")))
    distinct = ready.select("features").distinct().limit(largest + 1).count()
    tried = []
    for k in range(2, min(largest, distinct - 1) + 1):
        labelled = materialise(cluster(ready, "kmeans", k=k))
        found = labelled.select("cluster").distinct().count()
        tried.append((silhouette(labelled, "cluster") if found > 1 else -1.0, -k, labelled))
    if not tried:
        raise ValueError("fewer than three different rows")
    value, k, best = max(tried, key=lambda t: t[:2])
    return best.select(F.col("key").alias(key), "cluster", F.lit(-k).alias("k"), F.lit(value).alias("silhouette"))


@dataclass
class Segments:
    rows: DataFrame
    profile: DataFrame
    projection: DataFrame
    entity: str | None


def segment_pipeline(df: DataFrame, k: int = 4, target: str | None = None, entity_col: str | None = None,
                 model: str = "kmeans", **params) -> Segments:
    """One row per entity, clustered, described and projected to two dimensions."""
    if target:
        df = df.drop(target)
    found = entity.aggregate_entities(df, entity=entity_col)
    exclude = [found.entity] if found.entity else []
    plan = prepare.clustering_plan(found.table, exclude)
    ready = plan.transform(found.table)
    # rows are numbered in the order of the entity or of their digest, so equal rows stay two rows
    order = F.col(found.entity) if found.entity else row_digest(found.table)
    ready = materialise(positions(ready.withColumn("_order", order), ["_order"], "key").drop("_order"))
    rows = cluster(ready, model, k=k, **params).withColumnRenamed("cluster", "segment")
    projection, shares = features.project(rows, k=2)
    return Segments(
        rows.drop("features", "key"), segments.profile(rows.drop("features", "key", *exclude), "segment"),
        projection.select(*exclude, "segment", "component_1", "component_2", F.lit(sum(shares)).alias("explained")),
        found.entity)


# -- anomalies -------------------------------------------------------------------------------------

@dataclass
class Anomalies:
    mode: dict
    rows: DataFrame
    importance: DataFrame
    summary: DataFrame
    projection: DataFrame
    features: list[str]


def anomaly_pipeline(df: DataFrame, key: str, mode: str = "Auto", method: str = "isolation_forest",
                 contamination: float = 0.05, window: int = 12, budget: int | None = None, trees: int = 100) -> Anomalies:
    """Picks a time-series or tabular reading of the table, builds features, scores and explains.

    With ``budget``, only so many features of the largest variance are scored. Rows without a time
    have no place in a series: they come back with a null score and ``is_anomaly`` 0.
    """
    resolved = timeaxis.resolve_mode(df, mode)
    exclude = [c for c in (resolved["column"], key) if c]
    numeric = features.select_numeric(df, exclude, budget)
    if not numeric:
        raise ValueError("no usable numeric columns")
    if resolved["resolved"] == "Time-series":
        timed = timeaxis.parse_timestamp(df, resolved["column"], "_time")
        table, names = features.timeseries_features(timed, "_time", key, numeric, window)
        table = prepare.impute_robust(table, names)
        unplaced = timed.filter("_time IS NULL")
    else:
        table, unplaced = features.tabular_features(df, numeric), None
        names = numeric + list(features.row_statistics(numeric))
    if budget is not None and len(names) > budget:
        names = features.widest(table, names, budget)
    scaler = prepare.Scaler.fit(table, names)
    scaled_names = [f"_z_{i}" for i in range(len(names))]
    scaled = table.withColumns({z: scaler.expression(c) for z, c in zip(scaled_names, names)})
    if method == "isolation_forest":
        forest = isolation.IsolationForest.fit(scaled, scaled_names, key, trees=trees)
        scored = forest.score(scaled)
    elif method == "local_outlier_factor":
        points = scaled.select(F.col(key).cast("bigint").alias("key"), F.array(*scaled_names).alias("features"))
        factor = density.local_outlier_factor(points).select(F.col("key").alias(key), F.col("lof").alias("anomaly_score"))
        scored = scaled.join(factor, key)
    else:
        raise ValueError(f"no method {method!r}")
    # scored once: the quantile, the explanation and the output read the stored rows
    scored = materialise(scored)
    flagged = anomaly.label_by_share(scored, "anomaly_score", contamination)
    vectors = flagged.select(key, "anomaly_score", "is_anomaly", array_to_vector(F.array(*scaled_names)).alias("features"))
    projection, shares = features.project(vectors, k=2)
    flagged = flagged.drop(*scaled_names)
    rows = flagged
    if unplaced is not None:
        rows = flagged.unionByName(unplaced.withColumn("is_anomaly", F.lit(0)), allowMissingColumns=True)
    return Anomalies(
        resolved, rows, anomaly.importance(flagged, names), anomaly.summary(flagged),
        projection.select(key, "anomaly_score", "is_anomaly", "component_1", "component_2", F.lit(sum(shares)).alias("explained")),
        names)


# -- ranking ---------------------------------------------------------------------------------------

def upsell_pipeline(df: DataFrame, target: str, key: str, top: int = 50, settings: automl.Settings | None = None) -> DataFrame:
    """Test rows by the probability of the best churn-style model."""
    result = automl.automl_churn(df, target, key, settings)
    return recommend.rank_by_score(result.scored.drop("label", "prediction"), "score", key, target, top)


def propensity_pipeline(df: DataFrame, target: str, key: str, top: int = 50, settings: automl.Settings | None = None) -> DataFrame:
    """Test rows by purchase propensity, from the general preparation."""
    from tallyforge.operators.roles import binary_target

    encoded = df.withColumn(target, binary_target(df, target))
    result = automl.automl_supervised(encoded, target, key, settings)
    return recommend.rank_by_score(result.scored.drop("label", "prediction"), "score", key, target, top)


def as_vectors(df: DataFrame, columns: list[str], key: str) -> DataFrame:
    return df.select(F.col(key).cast("bigint").alias("key"),
                     array_to_vector(F.array(*[F.col(c).cast("double") for c in columns])).alias("features"))
