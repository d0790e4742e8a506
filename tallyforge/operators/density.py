"""Density clustering and local outlier scores on top of the neighbour searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.components import connected_components
from tallyforge.operators.nearest import links_within, nearest, unit, within
from tallyforge.operators.ordering import positions
from tallyforge.session import materialise


def dbscan(df: DataFrame, key: str = "key", features: str = "features", eps: float = 0.5,
           min_samples: int = 5, metric: str = "euclidean") -> DataFrame:
    """``(key, cluster, is_core)``; noise is -1, clusters are numbered by their smallest core key.

    A border row takes the first of the clusters it touches. Rows at the same place are handled
    as one place with a weight.
    """
    shape = unit if metric == "cosine" else (lambda x: x)
    radius = (2.0 * eps) ** 0.5 if metric == "cosine" else eps
    straight = "euclidean" if metric == "cosine" else metric
    rows = df.select(F.col(key).cast("bigint").alias("key"), shape(F.col(features).cast("array<double>")).alias("x"))
    places = materialise(rows.groupBy("x").agg(F.min("key").alias("key"), F.count("*").alias("weight")))
    sites = places.select(F.col("key").alias("site"), "x")
    counts = within(places, sites, radius, "sum", "weight", straight)
    rated = materialise(
        places.join(counts, places["key"] == counts["site"], "left")
        .select("key", "x", (F.coalesce("value", F.lit(0)) >= min_samples).alias("is_core")))
    core = rated.filter("is_core").select("key", "x")
    if core.isEmpty():
        return rows.select(F.col("key").alias(key), F.lit(-1).cast("bigint").alias("cluster"), F.lit(0).alias("is_core"))
    roots = connected_components(links_within(core, radius, straight))
    rooted = materialise(
        core.join(roots, core["key"] == roots["node"], "left")
        .select("key", "x", F.coalesce("root", "key").alias("root")))
    border = rated.filter("NOT is_core").select(F.col("key").alias("site"), "x")
    touched = within(rooted, border, radius, "min", "root", straight).select(
        F.col("site").alias("key"), F.col("value").alias("root"))
    named = rooted.select("key", "root").unionByName(touched)
    numbers = positions(rooted.select("root").distinct(), ["root"], "cluster")
    labelled = (
        rated.join(named, "key", "left").join(numbers, "root", "left")
        .select("x", F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.col("is_core").cast("int").alias("is_core")))
    return rows.join(labelled, "x").select(F.col("key").alias(key), "cluster", "is_core")


def lof_neighbours(n: int) -> int:
    """Neighbours used for a table of ``n`` rows: a twentieth of it, between 6 and 35."""
    return min(max(6, min(35, n // 20)), max(2, n - 1))


def local_outlier_factor(df: DataFrame, key: str = "key", features: str = "features",
                         k: int | None = None) -> DataFrame:
    """``(key, lof)``: mean neighbour density over own density; about 1 inside, larger outside."""
    k = k or lof_neighbours(df.count())
    near = materialise(nearest(df, k, key=key, features=features))
    reach = near.groupBy("query").agg(F.max("distance").alias("k_distance"))
    reached = near.join(reach.select(F.col("query").alias("neighbour"), "k_distance"), "neighbour")
    density = reached.groupBy("query").agg(
        (1.0 / (F.avg(F.greatest("distance", "k_distance")) + F.lit(1e-10))).alias("lrd"))
    density = materialise(density)
    theirs = near.join(density.select(F.col("query").alias("neighbour"), F.col("lrd").alias("their_lrd")), "neighbour")
    mean = theirs.groupBy("query").agg(F.avg("their_lrd").alias("m"))
    return mean.join(density, "query").select(
        F.col("query").alias(key), (F.col("m") / F.col("lrd")).alias("lof"))


def neighbour_vote(train: DataFrame, test: DataFrame, label: str, k: int = 5, key: str = "key",
                   features: str = "features", weights: str = "uniform") -> DataFrame:
    """Class of each test row by the vote of its ``k`` nearest training rows, and the vote share.

    A tied vote goes to the smallest label. With ``distance`` weights an exact match outvotes
    everything else.
    """
    near = _with_target(train, test, label, k, key, features, weights)
    votes = near.groupBy("query", "target").agg(F.sum("w").alias("w"))
    best = F.min(F.struct((-F.col("w")).alias("neg"), F.col("target").alias("target")))
    out = votes.groupBy("query").agg(best.alias("best"), F.sum("w").alias("all"))
    return out.select(F.col("query").alias(key), F.col("best.target").alias("prediction"),
                      (-F.col("best.neg") / F.col("all")).alias("confidence"))


def neighbour_mean(train: DataFrame, test: DataFrame, target: str, k: int = 5, key: str = "key",
                   features: str = "features", weights: str = "uniform") -> DataFrame:
    near = _with_target(train, test, target, k, key, features, weights)
    mean = F.sum(F.col("w") * F.col("target").cast("double")) / F.sum("w")
    return near.groupBy("query").agg(mean.alias("prediction")).withColumnRenamed("query", key)


def _with_target(train, test, target, k, key, features, weights) -> DataFrame:
    near = nearest(train, k, test, key, features)
    known = train.select(F.col(key).cast("bigint").alias("neighbour"), F.col(target).alias("target"))
    joined = near.join(known, "neighbour")
    if weights == "uniform":
        return joined.withColumn("w", F.lit(1.0))
    touching = F.min("distance").over(Window.partitionBy("query")) == 0  # k rows per query
    w = F.when(touching, (F.col("distance") == 0).cast("double")).otherwise(1.0 / F.col("distance"))
    return joined.withColumn("w", w)
