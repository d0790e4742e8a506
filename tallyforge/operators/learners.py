"""Supervised learners: Spark's own where they exist, compositions of them where they do not.

Everything here follows one protocol: ``build(...)`` gives an object with ``fit(df)``, whose result
has ``transform(df)``. Input columns are ``features`` (vector), ``label`` (double) and, for the
neighbour methods, ``key``; output columns are ``prediction`` and ``probability`` where there is one.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor, LinearRegression, RandomForestRegressor,
)
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.boosting import AdaBoost, AdaBoostRegressor, GradientBoosting
from tallyforge.operators.density import neighbour_mean, neighbour_vote
from tallyforge.operators.persistence import StoredModel, array_table, arrays_of
from tallyforge.operators.tube import TubeModel, TubeRegression

SEED = 42
# Depth that stands in for "unlimited"; Spark rejects more than 30 and doubles memory per level.
TREE_DEPTH = 20
FOREST_DEPTH = 12


class GaussianBayes(Estimator):
    """Normal densities per class and feature: one vector aggregate to fit, Arrow batches to apply."""

    SMOOTHING = 1e-9

    def _fit(self, df: DataFrame) -> "GaussianBayesModel":
        found = Summarizer.metrics("count", "mean", "variance").summary(F.col("features")).alias("s")
        rows = df.groupBy("label").agg(found).orderBy("label").collect()  # one row a class
        whole = df.agg(found).first().s
        counts = np.array([r.s["count"] for r in rows], float)
        means = np.array([r.s["mean"].toArray() for r in rows])
        spreads = np.array([r.s["variance"].toArray() for r in rows]) * np.maximum(0.0, (counts - 1) / counts)[:, None]
        extra = self.SMOOTHING * (whole["variance"].toArray() * (whole["count"] - 1) / whole["count"]).max()
        return GaussianBayesModel(np.array([float(r.label) for r in rows]), np.log(counts / counts.sum()), means, spreads + extra)


class GaussianBayesModel(StoredModel):
    def __init__(self, classes: np.ndarray, priors: np.ndarray, means: np.ndarray, variances: np.ndarray):
        super().__init__()
        self.classes, self.priors, self.means, self.variances = classes, priors, means, variances

    def _transform(self, df: DataFrame) -> DataFrame:
        classes, means, variances = self.classes, self.means, self.variances
        constants = self.priors - 0.5 * np.log(2 * math.pi * variances).sum(axis=1)

        @F.pandas_udf("prediction double, probability array<double>")
        def classify(xs: pd.Series) -> pd.DataFrame:
            if not len(xs):
                return pd.DataFrame({"prediction": [], "probability": []})
            x = np.vstack(xs.to_numpy())
            scores = np.stack([c - ((x - m) ** 2 / (2.0 * v)).sum(axis=1) for c, m, v in zip(constants, means, variances)], axis=1)
            parts = np.exp(scores - scores.max(axis=1, keepdims=True))
            return pd.DataFrame({"prediction": classes[scores.argmax(axis=1)], "probability": list(parts / parts.sum(axis=1, keepdims=True))})

        found = df.withColumn("_found", classify(vector_to_array("features")))
        return found.withColumns({"prediction": F.col("_found.prediction"),
                                  "probability": array_to_vector(F.col("_found.probability"))}).drop("_found")

    def contents(self, spark):
        return {}, {"densities": array_table(spark, classes=self.classes, priors=self.priors, means=self.means, variances=self.variances)}, {}

    @classmethod
    def restored(cls, facts, tables, models):
        return cls(**arrays_of(tables["densities"]))


# Of the sine of a part of a turn, up to a quarter on both sides: the rest is below 1e-15.
_SINE = [(-1) ** i * (2.0 * math.pi) ** (2 * i + 1) / math.factorial(2 * i + 1) for i in range(10)]


def cosines(turns: np.ndarray) -> np.ndarray:
    """Cosines of angles in turns, by a polynomial over the whole block at once."""
    x = turns - np.rint(turns)
    np.abs(x, out=x)
    np.subtract(0.25, x, out=x)
    square, out = x * x, np.full_like(x, _SINE[-1])
    for c in _SINE[-2::-1]:
        out *= square
        out += c
    out *= x
    return out


class FourierFeatures:
    """Random cosine features whose inner products approximate the rbf kernel."""

    def __init__(self, w: np.ndarray, b: np.ndarray):
        self.w, self.b = w, b

    @classmethod
    def drawn(cls, width: int, gamma: float, count: int = 128, seed: int = SEED) -> "FourierFeatures":
        rng = np.random.default_rng(seed)
        return cls(rng.normal(scale=math.sqrt(2.0 * gamma), size=(width, count)), rng.uniform(0.0, 2.0 * math.pi, size=count))

    def rows(self, x: np.ndarray) -> np.ndarray:
        out = cosines(x @ (self.w / (2.0 * math.pi)) + self.b / (2.0 * math.pi))
        out *= math.sqrt(2.0 / len(self.b))
        return out

    def transform(self, df: DataFrame, out: str) -> DataFrame:
        rows = self.rows

        @F.pandas_udf("array<double>")
        def lifted(xs: pd.Series) -> pd.Series:
            if not len(xs):
                return pd.Series([], dtype=object)
            return pd.Series(list(rows(np.vstack(xs.to_numpy()))))

        return df.withColumn(out, array_to_vector(lifted(vector_to_array("features"))))


def scale_gamma(df: DataFrame) -> float:
    """1 / (features * variance of all entries)."""
    x = vector_to_array("features")
    total = lambda f: F.sum(F.aggregate(x, F.lit(0.0), f))
    row = df.agg(total(lambda s, v: s + v).alias("s"), total(lambda s, v: s + v * v).alias("q"),
                 F.sum(F.size(x)).alias("n"), F.max(F.size(x)).alias("d")).first()
    variance = row.q / row.n - (row.s / row.n) ** 2
    return 1.0 / (row.d * variance) if variance > 0 else 1.0


class KernelMachine(Estimator):
    """Support vectors with an rbf kernel, as a linear machine over random cosine features; regression
    with the tube of ``epsilon`` around the labels."""

    def __init__(self, task: str, c: float = 1.0, kernel: str = "rbf", classes: int = 2, gamma: str | float = "scale",
                 epsilon: float = 0.1):
        super().__init__()
        self.task, self.c, self.kernel, self.classes, self.gamma, self.epsilon = task, c, kernel, classes, gamma, epsilon

    def width(self, df: DataFrame) -> float:
        """The kernel's gamma: a number, ``auto`` (1 / features) or ``scale`` (also by the variance)."""
        if self.gamma == "auto":
            return 1.0 / len(df.select("features").first().features)
        return scale_gamma(df) if self.gamma == "scale" else float(self.gamma)

    def _fit(self, df: DataFrame) -> "KernelMachineModel":
        lift = None
        if self.kernel == "rbf":
            lift = FourierFeatures.drawn(len(df.select("features").first().features), self.width(df))
        if self.task == "regression":
            found = TubeRegression(self.c, self.epsilon, lift.rows if lift else None).fit(df)
            found.features = "_lifted"
            return KernelMachineModel(lift, found, None)
        n = df.count()
        df = (lift.transform(df, "_lifted") if lift else df.withColumn("_lifted", F.col("features"))).persist()
        machine = LinearSVC(featuresCol="_lifted", regParam=1.0 / (self.c * n), maxIter=100)
        if self.classes > 2:
            model, platt = OneVsRest(classifier=machine, featuresCol="_lifted").fit(df), None
        else:
            model = machine.fit(df)
            margins = model.transform(df).select("label", _margin("rawPrediction"))
            platt = LogisticRegression(featuresCol="_margin").fit(margins)
        df.unpersist()
        return KernelMachineModel(lift, model, platt)


def _margin(raw: str) -> Column:
    return array_to_vector(F.array(vector_to_array(raw)[1])).alias("_margin")


class KernelMachineModel(StoredModel):
    def __init__(self, lift, model, platt):
        super().__init__()
        self.lift, self.model, self.platt = lift, model, platt

    def contents(self, spark):
        tables = {"lift": array_table(spark, w=self.lift.w, b=self.lift.b)} if self.lift else {}
        return {}, tables, {"model": self.model, **({"platt": self.platt} if self.platt else {})}

    @classmethod
    def restored(cls, facts, tables, models):
        lift = FourierFeatures(**arrays_of(tables["lift"])) if "lift" in tables else None
        return cls(lift, models["model"], models.get("platt"))

    def _transform(self, df: DataFrame) -> DataFrame:
        if isinstance(self.model, TubeModel) and self.lift:
            return self.model.predicted(df, "features", self.lift.rows)  # lifted rows are never moved
        lifted = self.lift.transform(df, "_lifted") if self.lift else df.withColumn("_lifted", F.col("features"))
        out = self.model.transform(lifted)
        if self.platt is None:
            return out.drop("_lifted", "rawPrediction")
        out = out.withColumnsRenamed({"prediction": "_side", "rawPrediction": "_raw"})
        out = out.withColumn("_margin", _margin("_raw"))
        scored = self.platt.transform(out).drop("prediction", "rawPrediction")
        return scored.withColumnRenamed("_side", "prediction").drop("_lifted", "_raw", "_margin")


class Neighbours(Estimator):
    """Nearest-neighbour classifier or regressor; needs the ``key`` column."""

    def __init__(self, task: str, k: int = 5, weights: str = "uniform"):
        super().__init__()
        self.task, self.k, self.weights = task, k, weights

    def _fit(self, df: DataFrame) -> "NeighboursModel":
        return NeighboursModel(df.select("key", vector_to_array("features").alias("x"), "label"), self.task, self.k, self.weights)


class NeighboursModel(StoredModel):
    whole_tables = True

    def __init__(self, train: DataFrame, task: str, k: int, weights: str):
        super().__init__()
        self.train, self.task, self.k, self.weights = train, task, k, weights

    def _transform(self, df: DataFrame) -> DataFrame:
        asked = df.select("key", vector_to_array("features").alias("x"))
        if self.task == "regression":
            found = neighbour_mean(self.train, asked, "label", self.k, features="x", weights=self.weights)
            return df.join(found, "key")
        found = neighbour_vote(self.train, asked, "label", self.k, features="x", weights=self.weights)
        one = F.when(F.col("prediction") == 1, F.col("confidence")).otherwise(1.0 - F.col("confidence"))
        return df.join(found, "key").withColumn("probability", array_to_vector(F.array(1.0 - one, one))).drop("confidence")

    def contents(self, spark):
        return {"task": self.task, "k": self.k, "weights": self.weights}, {"train": self.train}, {}

    @classmethod
    def restored(cls, facts, tables, models):
        return cls(tables["train"], **facts)


class KeyColumn(StoredModel):
    """The row key under the name ``key`` that the learners use."""

    def __init__(self, name: str):
        super().__init__()
        self.name = name

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("key", F.col(self.name).cast("bigint"))

    def contents(self, spark):
        return {"name": self.name}, {}, {}

    @classmethod
    def restored(cls, facts, tables, models):
        return cls(facts["name"])


# -- the register ----------------------------------------------------------------------------------

CLASSIFIERS = (
    "random_forest", "gradient_boosting", "logistic", "adaboost", "gaussian_nb", "svm", "knn",
    "decision_tree", "boosted_xgb", "boosted_lgbm",
)
REGRESSORS = (
    "random_forest", "gradient_boosting", "adaboost", "svm", "knn", "decision_tree", "linear",
    "boosted_xgb", "boosted_lgbm",
)
# Presets of the two histogram boosting libraries: depth and step.
_BOOSTED = {"boosted_xgb": (6, 0.3), "boosted_lgbm": (5, 0.1)}


def build(name: str, task: str, rows: int, classes: int = 2, **p):
    """A learner by name. Parameters: n_estimators, max_depth, learning_rate, C, kernel,
    gamma, epsilon, n_neighbors, weights, min_samples_split, max_iter, weight_col."""
    depth, trees = p.get("max_depth"), int(p.get("n_estimators", 100))
    weight = {"weightCol": p["weight_col"]} if p.get("weight_col") else {}
    least = {"minInstancesPerNode": max(1, int(p.get("min_samples_split", 2)) // 2)}
    step = float(p.get("learning_rate", 0.1))
    regression = task == "regression"

    def boosted(depth, step, bins=32):
        if regression:
            return GradientBoosting(trees, step, depth, bins)
        one = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=step, maxBins=bins, seed=SEED, **weight)
        return one if classes <= 2 else OneVsRest(classifier=one, **weight)

    if name == "random_forest":
        kind = RandomForestRegressor if regression else RandomForestClassifier
        return kind(numTrees=trees, maxDepth=depth or FOREST_DEPTH, seed=SEED, maxMemoryInMB=1024, **weight)
    if name == "gradient_boosting":
        return boosted(depth or 3, step)
    if name in _BOOSTED:
        preset_depth, preset_step = _BOOSTED[name]
        return boosted(depth or preset_depth, float(p.get("learning_rate", preset_step)), 256)
    if name == "decision_tree":
        kind = DecisionTreeRegressor if regression else DecisionTreeClassifier
        return kind(maxDepth=depth or TREE_DEPTH, seed=SEED, **least, **weight)
    if name == "adaboost":
        rate = float(p.get("learning_rate", 1.0))
        return AdaBoostRegressor(trees, rate) if regression else AdaBoost(trees, rate, classes)
    if name == "svm":
        return KernelMachine(task, float(p.get("C", 1.0)), p.get("kernel", "rbf"), classes, p.get("gamma", "scale"),
                             float(p.get("epsilon", 0.1)))
    if name == "knn":
        return Neighbours(task, int(p.get("n_neighbors", 5)), p.get("weights", "uniform"))
    if name == "linear" and regression:
        return LinearRegression(regParam=0.0, solver="normal")
    if name == "logistic" and not regression:
        return LogisticRegression(regParam=1.0 / (float(p.get("C", 1.0)) * max(1, rows)), elasticNetParam=0.0,
                                  standardization=False, maxIter=int(p.get("max_iter", 1000)), **weight)
    if name == "gaussian_nb" and not regression:
        return GaussianBayes()
    raise ValueError(f"no {task} model named {name!r}")


class ScoreScale(StoredModel):
    """How predictions become a score, fixed when the model was trained.

    ``probability``: of class 1. ``anomaly``: the anomaly score. ``margin``: the decision value between
    the ends it had over the training rows, values beyond them cut to 0 or 1. ``prediction``: itself.
    """

    def __init__(self, kind: str, low: float = 0.0, high: float = 1.0, out: str = "score"):
        super().__init__()
        self.kind, self.low, self.high, self.out = kind, low, high, out

    @classmethod
    def fit(cls, predicted: DataFrame) -> "ScoreScale":
        """The scale of a model, from its predictions over the training rows."""
        if "probability" in predicted.columns:
            return cls("probability")
        if "anomaly_score" in predicted.columns:
            return cls("anomaly")
        if "rawPrediction" not in predicted.columns:
            return cls("prediction")
        if predicted.isStreaming:
            raise ValueError("a margin has no score without the scale of its training rows")
        raw = vector_to_array("rawPrediction")[1]
        ends = predicted.agg(F.min(raw).alias("low"), F.max(raw).alias("high")).first()
        return cls("margin", float(ends.low or 0.0), float(ends.high or 0.0))

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.kind == "probability":
            score = vector_to_array("probability")[1]
        elif self.kind == "margin":
            place = (vector_to_array("rawPrediction")[1] - F.lit(self.low)) / F.lit(self.high - self.low + 1e-9)
            score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), place))
        else:
            score = F.col("anomaly_score" if self.kind == "anomaly" else "prediction").cast("double")
        return df.withColumn(self.out, score)

    def contents(self, spark):
        return {"kind": self.kind, "low": self.low, "high": self.high, "out": self.out}, {}, {}

    @classmethod
    def restored(cls, facts, tables, models):
        return cls(**facts)


def with_score(predicted: DataFrame, out: str = "score", scale: ScoreScale | None = None) -> DataFrame:
    """Adds the score by a fitted scale; without one, margins are scaled by the rows at hand, which
    keeps their order only (enough for curves and ranks of one table)."""
    scale = scale or ScoreScale.fit(predicted)
    return ScoreScale(scale.kind, scale.low, scale.high, out).transform(predicted)


def importance(model, names: list[str]) -> list[tuple[str, float]]:
    """Tree importances or absolute coefficients (averaged over classes), largest first."""
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif hasattr(model, "importances"):
        values = model.importances
    elif hasattr(model, "coefficientMatrix"):
        values = np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(model, "coefficients"):
        values = np.abs(model.coefficients.toArray())
    else:
        return []
    if len(names) != len(values):
        names = [f"feature_{i + 1}" for i in range(len(values))]
    return sorted(zip(names, (abs(float(v)) for v in values)), key=lambda p: (-p[1], p[0]))
