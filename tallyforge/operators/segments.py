"""Describing segments and grading clusterings."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.columns import numeric_columns

# A table of this many numbers (64 MB of doubles) may be sent to every task.
BROADCAST_NUMBERS = 8_000_000


def distribution(df: DataFrame, cluster: str) -> DataFrame:
    """Rows and share per cluster; -1 is noise. The totals are taken over one row per cluster."""
    counts = df.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t")).first().t or 1
    name = F.when(F.col("cluster").cast("string") == "-1", F.lit("Noise")).otherwise(
        F.concat(F.lit("Cluster "), F.col("cluster").cast("string")))
    return counts.select("cluster", name.alias("name"), "n",
                         F.round(F.col("n") * 100.0 / F.lit(total), 2).alias("share_pct"))


def profile(df: DataFrame, segment: str, columns: list[str] | None = None) -> DataFrame:
    """Size, share and numeric means per segment, largest first."""
    columns = columns or numeric_columns(df, exclude=[segment])
    sizes = df.groupBy(segment).agg(
        F.count("*").alias("segment_size"), *[F.round(F.avg(c), 3).alias(c) for c in columns])
    total = df.count() or 1
    return sizes.select(
        F.col(segment).alias("segment"), "segment_size",
        F.round(F.col("segment_size") * 100.0 / F.lit(total), 2).alias("segment_share_pct"), *columns,
    ).orderBy(F.desc("segment_size"), "segment")


def actions(df: DataFrame, segment: str) -> DataFrame:
    """Recommended action per segment: a share of 30 % earns its own playbook."""
    counts = df.groupBy(F.col(segment).alias("segment")).agg(F.count("*").alias("records"))
    facts = counts.agg(F.sum("records").alias("t"), F.max("records").alias("m"), F.count("*").alias("k")).first()
    share = F.round(F.col("records") * 100.0 / F.lit(facts.t or 1), 2)
    action = F.when(share >= 30, "Create dedicated playbook").otherwise("Include in targeted cohort")
    return counts.select("segment", "records", share.alias("share_pct"), action.alias("recommended_action"),
                         F.lit(round(100.0 * (facts.m or 0) / (facts.t or 1), 2)).alias("largest_share_pct"),
                         F.lit(facts.k).alias("segments"))


def _centroids(df: DataFrame, cluster: str, features: str):
    """Size, mean vector and sum of squares per cluster; one row per cluster."""
    x = F.col(features)
    rows = df.groupBy(F.col(cluster).alias("c")).agg(
        F.count("*").alias("n"), Summarizer.mean(x).alias("mean"), Summarizer.normL2(x).alias("norm")).collect()
    return {r.c: (r.n, r["mean"].toArray(), float((r.norm.toArray() ** 2).sum())) for r in rows}


def vector_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two number arrays."""
    gaps = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v))


def calinski_harabasz(df: DataFrame, cluster: str, features: str = "features") -> float | None:
    """Between- over within-cluster dispersion, from cluster sums only."""
    c = _centroids(df, cluster, features)
    k, n = len(c), sum(v[0] for v in c.values())
    if k < 2 or n <= k:
        return None
    middle = sum(v[0] * v[1] for v in c.values()) / n
    between = sum(v[0] * float(((v[1] - middle) ** 2).sum()) for v in c.values())
    within = sum(v[2] - v[0] * float((v[1] ** 2).sum()) for v in c.values())
    return (between / (k - 1)) / (within / (n - k)) if within > 0 else 1.0


def davies_bouldin(df: DataFrame, cluster: str, features: str = "features") -> float | None:
    """Mean over clusters of the worst (spread + spread) / centroid distance."""
    c = _centroids(df, cluster, features)
    if len(c) < 2:
        return None
    width = len(next(iter(c.values()))[1])
    rows = [(key, [float(v) for v in mean]) for key, (_, mean, _) in c.items()]
    kind = df.schema[cluster].dataType.simpleString()
    table = df.sparkSession.createDataFrame(rows, f"c {kind}, mean array<double>")
    if len(c) * width <= BROADCAST_NUMBERS:
        table = F.broadcast(table)
    away = df.select(F.col(cluster).alias("c"), vector_to_array(features).alias("x")).join(table, "c")
    spread = {r.c: r.s for r in away.groupBy("c").agg(F.avg(vector_distance(F.col("x"), F.col("mean"))).alias("s")).collect()}
    keys = list(c)
    means = np.array([c[key][1] for key in keys])
    s = np.array([spread[key] for key in keys])
    worst = []
    for i in range(len(keys)):  # one row of the centroid distances at a time
        gap = np.sqrt(((means - means[i]) ** 2).sum(axis=1))
        gap[i] = np.inf
        with np.errstate(divide="ignore"):
            worst.append(float(np.max((s + s[i]) / gap)))
    return float(np.mean(worst))
