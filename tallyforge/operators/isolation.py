"""Isolation forest: trees grown on small hashed subsamples, scored in vectorised batches."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.hashing import hash_bucket, hash_unit
from tallyforge.operators.persistence import StoredModel
from tallyforge.operators.quantiles import column_quantiles

TREES = 100
SUBSAMPLE = 256
EULER = 0.5772156649015329


def average_path(n) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of ``n`` rows."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def subsamples(df: DataFrame, key: str, trees: int, size: int, seed: int) -> DataFrame:
    """``size`` rows for each tree, drawn by hash from a pool a few times larger than all trees need.

    The pool keeps the work of drawing independent of the table: one hash per row picks it.
    """
    n = df.count()
    share = 2.0 * trees * size / max(1, n)
    pool = df if share >= 1.0 else df.filter(hash_unit(key, f"{seed}pool") < share)
    numbered = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    draw = hash_bucket(F.concat_ws("/", F.col(key), F.col("tree")), seed, 2 ** 32)
    order = Window.partitionBy("tree").orderBy("_draw", key)
    return (
        numbered.withColumn("_draw", draw).withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= size).drop("_draw", "_rank"))


def grow(rows: pd.DataFrame, columns: list[str], key: str, seed: int) -> pd.DataFrame:
    """One tree over at most a few hundred rows, as a node table."""
    tree = int(rows["tree"].iloc[0])
    x = rows.sort_values(key)[columns].to_numpy(dtype=float)
    rng = np.random.default_rng([seed, tree])
    limit = math.ceil(math.log2(max(2, len(x))))
    nodes, waiting = [], [(0, np.arange(len(x)), 0)]
    used = 1
    while waiting:
        node, members, depth = waiting.pop()
        low, high = x[members].min(axis=0), x[members].max(axis=0)
        open_columns = np.flatnonzero(high > low)
        if depth >= limit or len(members) <= 1 or not len(open_columns):
            nodes.append((tree, node, -1, 0.0, -1, -1, float(depth + average_path([len(members)])[0])))
            continue
        c = int(rng.choice(open_columns))
        cut = float(rng.uniform(low[c], high[c]))
        side = x[members, c] <= cut
        left, right = used, used + 1
        used += 2
        nodes.append((tree, node, c, cut, left, right, 0.0))
        waiting += [(left, members[side], depth + 1), (right, members[~side], depth + 1)]
    return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "left", "right", "path"])


NODE_SCHEMA = "tree int, node int, feature int, cut double, left int, right int, path double"


@dataclass(eq=False)
class IsolationForest(StoredModel):
    """A fitted forest: a few hundred nodes per tree, held as arrays.

    As a stage it adds ``anomaly_score`` and, where a threshold was fitted, ``prediction``: -1 for
    anomalies, 1 for the rest.
    """

    columns: list[str]
    subsample: int
    nodes: list[dict]
    threshold: float | None = None

    def __post_init__(self):
        super().__init__()

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], key: str, trees: int = TREES,
            subsample: int = SUBSAMPLE, seed: int = 42) -> "IsolationForest":
        columns = list(columns)
        doubles = df.select(F.col(key).cast("bigint").alias(key), *[F.col(c).cast("double").alias(c) for c in columns])
        drawn = subsamples(doubles, key, trees, subsample, seed)
        table = drawn.groupBy("tree").applyInPandas(lambda rows: grow(rows, columns, key, seed), NODE_SCHEMA)
        rows = table.toPandas()  # at most 2 * subsample nodes per tree
        used = min(subsample, df.count())
        nodes = []
        for _, part in rows.groupby("tree", sort=True):
            part = part.sort_values("node")
            nodes.append({n: part[n].to_numpy() for n in ("feature", "cut", "left", "right", "path")})
        return cls(columns, used, nodes)

    def contents(self, spark):
        rows = [(i, j, *[(int if n in ("feature", "left", "right") else float)(tree[n][j])
                         for n in ("feature", "cut", "left", "right", "path")])
                for i, tree in enumerate(self.nodes) for j in range(len(tree["feature"]))]
        facts = {"columns": self.columns, "subsample": int(self.subsample), "threshold": self.threshold}
        return facts, {"nodes": spark.createDataFrame(rows, NODE_SCHEMA)}, {}

    @classmethod
    def restored(cls, facts, tables, models):
        rows = tables["nodes"].orderBy("tree", "node").toPandas()  # bounded by trees and subsample
        nodes = [{n: part[n].to_numpy() for n in ("feature", "cut", "left", "right", "path")}
                 for _, part in rows.groupby("tree", sort=True)]
        return cls(facts["columns"], facts["subsample"], nodes, facts["threshold"])

    def _transform(self, df: DataFrame) -> DataFrame:
        scored = self.score(df)
        if self.threshold is None:
            return scored
        odd = F.col("anomaly_score") > self.threshold
        return scored.withColumn("prediction", F.when(odd, F.lit(-1.0)).otherwise(F.lit(1.0)))

    def score(self, df: DataFrame, out: str = "anomaly_score") -> DataFrame:
        """2 ** (-mean path / expected path): near 1 for rows that are easy to isolate."""
        nodes, scale = self.nodes, float(average_path([self.subsample])[0])

        @F.pandas_udf("double")
        def depth(xs: pd.Series) -> pd.Series:
            if not len(xs):
                return pd.Series([], dtype=float)
            x = np.vstack(xs.to_numpy())
            row, total = np.arange(len(x)), np.zeros(len(x))
            for tree in nodes:
                at = np.zeros(len(x), dtype=np.int64)
                while True:
                    f = tree["feature"][at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    left = x[row, np.maximum(f, 0)] <= tree["cut"][at]
                    at = np.where(inner, np.where(left, tree["left"][at], tree["right"][at]), at)
                total += tree["path"][at]
            return pd.Series(2.0 ** (-(total / len(nodes)) / scale))

        return df.withColumn(out, depth(F.array(*[F.col(c).cast("double") for c in self.columns])))


class Isolation(Estimator):
    """The forest as a pipeline stage. The threshold leaves the share ``contamination`` of the training
    rows above it (rows at the threshold are no anomalies)."""

    def __init__(self, columns: list[str], key: str, trees: int = TREES, subsample: int = SUBSAMPLE, contamination: float = 0.1):
        super().__init__()
        self.columns, self.key, self.trees, self.subsample, self.contamination = list(columns), key, trees, subsample, contamination

    def _fit(self, df: DataFrame) -> IsolationForest:
        forest = IsolationForest.fit(df, self.columns, self.key, self.trees, self.subsample)
        scores = forest.score(df).select("anomaly_score").persist()
        found = column_quantiles(scores, ["anomaly_score"], [1.0 - self.contamination])["anomaly_score"][0]
        scores.unpersist()
        forest.threshold = None if found is None else float(found)
        return forest
