"""Silhouette values on squared distances.

The average squared distance of a row to a cluster follows exactly from the cluster's sums, so the
value takes one pass over the rows and is the same definition at every size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Numbers (clusters times columns) that every task holds; more clusters than that are refused.
CLUSTER_NUMBERS = 20_000_000
# Numbers (rows times clusters) that a task compares at once.
ROW_NUMBERS = 1_000_000


def _arrays(df: DataFrame, cluster: str, features: str) -> DataFrame:
    x = vector_to_array(features) if isinstance(df.schema[features].dataType, VectorUDT) else F.col(
        features).cast("array<double>")
    return df.withColumn("_x", x).withColumn("_c", F.col(cluster).cast("string"))


def silhouette_samples(df: DataFrame, cluster: str, features: str = "features") -> DataFrame:
    """Adds ``silhouette``: (b - a) / max(a, b) of the mean squared distances to the row's own and
    to the nearest other cluster; 0 for a row that is alone in its cluster."""
    ready = _arrays(df, cluster, features)
    first = ready.select("_x").first()
    width = len(first["_x"]) if first else 0
    found = ready.groupBy("_c").agg(F.count("*").alias("n")).limit(CLUSTER_NUMBERS // max(width, 1) + 1).collect()
    sizes = {r["_c"]: r["n"] for r in found}
    if len(sizes) < 2:
        raise ValueError("a silhouette needs at least two clusters")
    if len(sizes) * width > CLUSTER_NUMBERS:
        raise ValueError(f"more than {CLUSTER_NUMBERS // width} clusters")
    names = sorted(sizes)
    return ready.withColumn("silhouette", _squared(ready, names, sizes, width)).drop("_x", "_c")


def _squared(ready: DataFrame, names: list[str], sizes: dict, width: int):
    rows = ready.groupBy("_c").agg(
        *[F.sum(F.col("_x")[j]).alias(f"s{j}") for j in range(width)],
        F.sum(F.aggregate("_x", F.lit(0.0), lambda s, v: s + v * v)).alias("q")).collect()
    found = {r["_c"]: r for r in rows}
    sums = np.array([[found[n][f"s{j}"] for j in range(width)] for n in names])
    squares = np.array([found[n]["q"] for n in names])
    held, place = np.array([sizes[n] for n in names], dtype=float), {n: i for i, n in enumerate(names)}

    @F.pandas_udf("double")
    def score(xs: pd.Series, cs: pd.Series) -> pd.Series:
        every, own = np.vstack(xs.to_numpy()), cs.map(place).to_numpy()
        out, rows = np.empty(len(every)), max(1, ROW_NUMBERS // len(held))
        for i in range(0, len(every), rows):
            x, mine = every[i:i + rows], own[i:i + rows]
            total = held * (x * x).sum(axis=1)[:, None] + squares - 2.0 * x @ sums.T
            out[i:i + rows] = _score(np.maximum(total, 0.0), mine, held)
        return pd.Series(out)

    return score(F.col("_x"), F.col("_c"))


def _score(total: np.ndarray, mine: np.ndarray, held: np.ndarray) -> np.ndarray:
    row = np.arange(len(mine))
    a = total[row, mine] / np.maximum(held[mine] - 1, 1)
    other = total / held
    other[row, mine] = np.inf
    b = other.min(axis=1)
    top = np.maximum(a, b)
    out = np.divide(b - a, top, out=np.zeros_like(a), where=top > 0)
    out[held[mine] == 1] = 0.0
    return out


def silhouette(df: DataFrame, cluster: str, features: str = "features") -> float:
    return silhouette_samples(df, cluster, features).agg(F.avg("silhouette").alias("s")).first().s
