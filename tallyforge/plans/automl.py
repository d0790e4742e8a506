"""Composed supervised runs: prepare, train every model, rank them, keep the scored test rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.columns import families
from tallyforge.operators import imbalance, learners, prepare, roles, splits
from tallyforge.operators.registry import Bundle, Registry, fingerprint, signature
from tallyforge.plans import tuning


@dataclass
class Settings:
    models: list[str] = field(default_factory=list)
    metric: str = ""
    test_share: float = 0.2
    cv: str | int = "Auto"
    tune: bool = False
    imbalance: str = "none"
    params: dict = field(default_factory=dict)


def default_settings(task: str) -> Settings:
    """Defaults of the automatic mode."""
    if task == "clustering":
        raise ValueError("clustering has its own run: flows.automl_cluster")
    if task == "classification":
        return Settings(["boosted_lgbm", "boosted_xgb", "random_forest", "logistic"], "roc_auc", params={"n_estimators": 200})
    return Settings(["boosted_lgbm", "boosted_xgb", "random_forest", "linear"], "r2", params={"n_estimators": 200})


def churn_settings() -> Settings:
    return Settings(["logistic", "random_forest", "boosted_xgb", "boosted_lgbm"], "roc_auc", cv=5,
                    imbalance="smote", params={"n_estimators": 200})


@dataclass
class Result:
    task: str
    best: str
    leaderboard: DataFrame
    metrics: DataFrame
    scored: DataFrame
    summary: DataFrame
    importance: list
    classes: list
    model: PipelineModel | None = None  # key, preparation, best model and score scale, from raw rows
    features: list = field(default_factory=list)  # the raw columns it reads

    def store(self, registry: Registry, df: DataFrame, config: dict | None = None) -> Bundle:
        """Puts the best model with its preparation into a registry. ``df`` are the rows of the run."""
        config = {**(config or {}), "classes": self.classes}
        sign = signature(fingerprint(df), self.task, self.best, config)
        return registry.put(self.model, df, sign, self.best, self.task, self.features, config)


def _finish(spark, df, key, target, task, classes, plan, done, settings, train, test, removed) -> Result:
    best = done[0]
    scale = learners.ScoreScale.fit(best.model.transform(train))
    scored = learners.with_score(best.model.transform(test), scale=scale) if task == "classification" else best.model.transform(test)
    kept = [c for c in ("label", "prediction", "score") if c in scored.columns]
    rows = df.join(scored.select(F.col("key").alias(key), *kept), key)
    return Result(
        task, best.name, tuning.leaderboard(spark, done, task, settings.metric), tuning.metric_table(spark, done),
        rows, plan.summary(spark, removed), learners.importance(best.model, plan.names), classes,
        PipelineModel([learners.KeyColumn(key), plan, best.model, scale]), [key, *plan.inputs])


def _folds(settings: Settings, task: str, train: DataFrame) -> int:
    if settings.cv == "None":
        return 0
    if task == "classification":
        least = min(splits.class_counts(train, "label").values())
        return splits.fold_count(settings.cv, task, 0, least)
    return splits.fold_count(settings.cv, task, train.count(), 0)


def automl_supervised(df: DataFrame, target: str, key: str, settings: Settings | None = None) -> Result:
    """Any target: the task follows from its type and distinct values."""
    spark = df.sparkSession
    df = prepare.drop_null_target(df, target)
    use = prepare.usable_general(df, target, key)
    nunique = roles.collect_facts(df, [target])[target].nunique
    task = roles.task_type(families(df)[target], nunique)
    settings = settings or default_settings(task)

    flagged = splits.random_split(df, key, settings.test_share)
    train, test = flagged.filter("is_test = 0"), flagged.filter("is_test = 1")
    before = test.count()
    test = splits.drop_unseen(train, test, use.low_card + use.high_card)
    removed = before - test.count()
    plan = prepare.fit_plan(train, use.numeric, use.low_card, use.high_card, use.ids)

    classes: list = []
    label = F.col(target).cast("double")
    if task == "classification":
        classes = sorted(splits.class_counts(df, target))
        label = F.coalesce(*[F.when(F.col(target) == F.lit(c), F.lit(float(i))) for i, c in enumerate(classes)])

    def ready(part: DataFrame) -> DataFrame:
        return plan.transform(part).select(F.col(key).cast("bigint").alias("key"), label.alias("label"), "features")

    train, test = ready(train), ready(test)
    done = tuning.train_all(
        settings.models, train, test, task, settings.metric, max(2, len(classes)), _folds(settings, task, train),
        settings.tune, settings.params)
    return _finish(spark, df, key, target, task, classes, plan, done, settings, train, test, removed)


def balancer(way: str):
    """A function that balances prepared rows ``key, label, features`` for training; None for none.

    It is given the rows that a model may learn from and nothing else. A class of a single row has no
    neighbour to make rows with, and then the rows stay as they are.
    """
    if way == "class_weight":
        return lambda rows: rows.withColumn("weight", imbalance.weight_column(imbalance.balanced_weights(rows, "label"), "label"))
    if way == "undersample":
        return lambda rows: imbalance.undersample(rows, "key", "label")
    if way not in ("smote", "adasyn"):
        return None

    def oversampled(rows: DataFrame) -> DataFrame:
        if min(splits.class_counts(rows, "label").values()) < 2:
            return rows
        made = getattr(imbalance, way)(rows.withColumn("features", vector_to_array("features")))
        return rows.unionByName(made.select(
            F.xxhash64("source", "copy").alias("key"), "label", array_to_vector("features").alias("features")))

    return oversampled


def automl_churn(df: DataFrame, target: str, key: str, settings: Settings | None = None) -> Result:
    """A yes/no target: encoded, split per class, balanced on the training rows only."""
    spark, settings = df.sparkSession, settings or churn_settings()
    labelled = df.withColumn("label", roles.binary_target(df, target).cast("double"))
    flagged = splits.stratified_split(labelled, key, "label", settings.test_share)
    numeric, strings, dropped = prepare.usable_churn(df, target, key)
    train_rows = flagged.filter("is_test = 0")
    plan = prepare.fit_plan(train_rows, numeric, strings, dropped=dropped, center="median", scaler="standard")
    ready = plan.transform(flagged).select(F.col(key).cast("bigint").alias("key"), "label", "features", "is_test")
    train, test = ready.filter("is_test = 0").drop("is_test"), ready.filter("is_test = 1").drop("is_test")
    params = dict(settings.params)
    if settings.imbalance == "class_weight":
        params["weight_col"] = "weight"
    done = tuning.train_all(settings.models, train, test, "classification", settings.metric, 2,
                            _folds(settings, "classification", train), settings.tune, params, balancer(settings.imbalance))
    return _finish(spark, df, key, target, "classification", [0, 1], plan, done, settings, train, test, 0)
