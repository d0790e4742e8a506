"""Evaluation, cross-validation, grid search and the leaderboard."""

from __future__ import annotations

import itertools
import statistics
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators import learners, metrics
from tallyforge.operators.splits import folds
from tallyforge.session import spread

# Fits that run at the same time; Spark's scheduler shares the executors between them.
PARALLEL = 4

GRIDS = {
    # The candidates searched per model.
    "random_forest": {"n_estimators": [100, 200], "max_depth": [None, 5, 10]},
    "gradient_boosting": {"n_estimators": [100, 200], "learning_rate": [0.05, 0.1]},
    "logistic": {"C": [0.1, 1, 10]},
    "adaboost": {"n_estimators": [50, 100], "learning_rate": [0.5, 1.0]},
    "svm": {"C": [0.1, 1, 10], "kernel": ["rbf", "linear"], "gamma": ["scale", "auto"]},
    "knn": {"n_neighbors": [3, 5, 7], "weights": ["uniform", "distance"]},
    "decision_tree": {"max_depth": [None, 5, 10, 15], "min_samples_split": [2, 5, 10]},
    "boosted_xgb": {"n_estimators": [100, 200], "max_depth": [3, 5, 7], "learning_rate": [0.01, 0.1, 0.2]},
    "boosted_lgbm": {"n_estimators": [100, 200], "max_depth": [3, 5, 7], "learning_rate": [0.01, 0.1, 0.2]},
}


def evaluate(predicted: DataFrame, task: str, classes: int = 2, features: int = 1) -> dict[str, float]:
    """All metrics of a scored table by name; the predictions are made once and cached."""
    kept = [c for c in ("label", "prediction", "probability", "rawPrediction") if c in predicted.columns]
    table = predicted.select(*kept).persist()
    try:
        if task == "regression":
            out = metrics.regression_metrics(table, "label", "prediction", features).first().asDict()
            out["median_ae"] = metrics.median_absolute_error(table, "label", "prediction").first()[0]
            return out
        out = metrics.classification_metrics(table, "label", "prediction").first().asDict()
        if classes == 2:
            two = metrics.binary_metrics(table, "label", "prediction").first().asDict()
            out.update({f"binary_{k}": v for k, v in two.items()})
            out.update(metrics.ranking_metrics(learners.with_score(table), "label", "score").first().asDict())
        else:
            # one score per class: probabilities, else decision values, else the vote
            source = next((c for c in ("probability", "rawPrediction") if c in kept), None)
            p = vector_to_array(source) if source else F.array(
                *[(F.col("prediction") == i).cast("double") for i in range(classes)])
            wide = table.select(F.col("label").cast("int").alias("label"), *[p[i].alias(f"s{i}") for i in range(classes)])
            out.update(metrics.roc_auc_multiclass(wide, "label", {str(i): f"s{i}" for i in range(classes)}).first().asDict())
        return out
    finally:
        table.unpersist()


# Names users pass for a metric, by task.
ALIASES = {
    "classification": {"f1": "binary_f1", "precision": "binary_precision", "recall": "binary_recall",
                       "matthews_corrcoef": "mcc", "auc": "roc_auc"},
    "regression": {"median_absolute_error": "median_ae", "mean_absolute_error": "mae", "mean_squared_error": "mse",
                   "root_mean_squared_error": "rmse"},
}
_EVERY = {
    "classification": ("accuracy", "balanced_accuracy", "f1_weighted", "f1_macro", "f1_micro", "precision_weighted",
                       "recall_weighted", "mcc", "cohen_kappa", "roc_auc"),
    "regression": ("r2", "adjusted_r2", "mae", "mse", "rmse", "mape", "max_error", "explained_variance", "median_ae"),
}
_BINARY = ("binary_f1", "binary_precision", "binary_recall", "average_precision")


def metric_name(metric: str, task: str, classes: int = 2) -> str:
    """The name under which ``evaluate`` gives a metric; an unknown one is an error before any fit.

    With more than two classes the plain f1, precision and recall are the weighted ones.
    """
    if task == "classification" and classes > 2:
        metric = {"f1": "f1_weighted", "precision": "precision_weighted", "recall": "recall_weighted"}.get(metric, metric)
    name = ALIASES[task].get(metric, metric)
    known = _EVERY[task] + (_BINARY if task == "classification" and classes <= 2 else ())
    if name not in known:
        raise ValueError(f"no {task} metric {metric!r}; known: {', '.join(sorted(known))}")
    return name


def score_of(values: dict[str, float], metric: str) -> float:
    """A value that is larger for the better model."""
    v = values.get(metric)
    if v is None:
        return float("-inf")
    return -v if metric in metrics.SMALLER_IS_BETTER else v


def cross_validate(make: Callable, df: DataFrame, task: str, metric: str, count: int, classes: int = 2,
                   resample: Callable | None = None) -> dict:
    """Mean and deviation of a metric over ``count`` folds, stratified for classes.

    ``resample`` balances rows for training; it sees the training part of one fold at a time, so no
    row that it makes or weighs knows anything of the rows that the fold is measured on.
    """
    metric = metric_name(metric, task, classes)
    folded = with_folds(df, task, count)
    try:
        return _over_folds(make, folded, task, metric, count, classes, resample)
    finally:
        folded.unpersist()


def with_folds(df: DataFrame, task: str, count: int) -> DataFrame:
    return spread(folds(df, "key", count, "label" if task == "classification" else None), "key").persist()


def _over_folds(make: Callable, folded: DataFrame, task: str, metric: str, count: int, classes: int,
                resample: Callable | None = None) -> dict:
    width = len(folded.select("features").first().features)

    def one(i: int) -> float | None:
        rest = folded.filter(F.col("fold") != i).drop("fold")
        model = make().fit(resample(rest) if resample else rest)
        return evaluate(model.transform(folded.filter(F.col("fold") == i)), task, classes, width).get(metric)

    with ThreadPoolExecutor(PARALLEL) as pool:
        values = [v for v in pool.map(one, range(count)) if v is not None]
    if not values:  # a fold of one class has no curve
        return {"mean": None, "std": None, "values": []}
    return {"mean": statistics.fmean(values), "std": statistics.pstdev(values), "values": values}


def grid_search(name: str, df: DataFrame, task: str, metric: str, count: int = 3, classes: int = 2,
                grid: dict | None = None, base: dict | None = None, resample: Callable | None = None) -> tuple[dict, list[dict]]:
    """Best parameters of a grid by cross-validation; the defaults when every candidate fails."""
    grid = GRIDS.get(name, {}) if grid is None else grid
    metric = metric_name(metric, task, classes)
    rows = df.count()
    folded = with_folds(df, task, count)  # once for the whole grid
    tried = []
    for values in itertools.product(*grid.values()):
        params = dict(zip(grid, values))
        make = lambda: learners.build(name, task, rows, classes, **{**(base or {}), **params})  # noqa: B023, E731
        try:
            result = _over_folds(make, folded, task, metric, count, classes, resample)
        except Exception as error:  # one failing candidate must not end the search
            tried.append({"params": params, "mean": None, "error": str(error)[:200]})
            continue
        tried.append({"params": params, "mean": result["mean"], "std": result["std"]})
    folded.unpersist()
    good = [r for r in tried if r["mean"] is not None]
    if not good:
        return {}, tried
    return max(good, key=lambda r: score_of({metric: r["mean"]}, metric))["params"], tried


@dataclass
class Trained:
    name: str
    model: object
    test: dict
    train: dict
    params: dict = field(default_factory=dict)
    cv: dict | None = None


def train_all(names, train: DataFrame, test: DataFrame, task: str, metric: str, classes: int = 2,
              cv_folds: int = 0, tune: bool = False, params: dict | None = None, resample: Callable | None = None) -> list[Trained]:
    """Fits every model on shared cached tables, best first.

    ``resample`` balances what a model learns from: all training rows for the final fit, the training
    part of each fold in cross-validation and search. Metrics are taken over rows as they are.
    """
    metric = metric_name(metric, task, classes)
    train, test = spread(train, "key").persist(), test.persist()
    rows, width = train.count(), len(train.select("features").first().features)
    learned = resample(train).persist() if resample else train

    def one(name: str) -> Trained:
        chosen = dict(params or {})
        if tune:
            chosen.update(grid_search(name, train, task, metric, max(3, min(cv_folds or 3, 5)), classes, base=params, resample=resample)[0])
        make = lambda: learners.build(name, task, rows, classes, **chosen)
        model = make().fit(learned)
        fitted = Trained(
            name, model, evaluate(model.transform(test), task, classes, width),
            evaluate(model.transform(train), task, classes, width), chosen)
        if cv_folds >= 2:
            fitted.cv = cross_validate(make, train, task, metric, cv_folds, classes, resample)
        return fitted

    with ThreadPoolExecutor(PARALLEL) as pool:
        done = list(pool.map(one, names))
    learned.unpersist()
    train.unpersist()
    test.unpersist()
    return sorted(done, key=lambda t: (-score_of(t.test, metric), t.name))


def leaderboard(spark, trained: list[Trained], task: str, metric: str) -> DataFrame:
    """One row per model with its rank, scores, overfit level and parameters."""
    headline = "r2" if task == "regression" else "accuracy"
    metric = next((m for m in (metric, ALIASES[task].get(metric)) if trained and m in trained[0].test), metric)
    rows = [
        (i + 1, t.name, metric, _number(t.test.get(metric)), _number(t.cv["mean"]) if t.cv else None,
         _number(t.cv["std"]) if t.cv else None, _number(t.train[headline]), _number(t.test[headline]),
         ", ".join(f"{k}={v}" for k, v in sorted(t.params.items())))
        for i, t in enumerate(trained)]
    table = spark.createDataFrame(
        rows, "rank int, model string, metric string, test_value double, cv_mean double, cv_std double, "
              "train_score double, test_score double, params string")
    return metrics.overfit_gap(table).withColumn("gap", F.round("gap", 6))


def metric_table(spark, trained: list[Trained]) -> DataFrame:
    """Every metric of every model in long form."""
    rows = [(t.name, split, k, _number(v)) for t in trained
            for split, values in (("test", t.test), ("train", t.train)) for k, v in values.items()]
    return spark.createDataFrame(rows, "model string, split string, metric string, value double")


def _number(v) -> float | None:
    return None if v is None else round(float(v), 6)
