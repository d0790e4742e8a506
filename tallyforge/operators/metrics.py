"""Evaluation metrics of scored tables.

All class metrics come from one ``(label, prediction)`` count table, all regression metrics from
one aggregate, and all threshold-free metrics from one table of counts per distinct score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.ordering import running_sums
from tallyforge.operators.quantiles import quantiles


def confusion_counts(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count("*").alias("n"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def class_table(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Per class: support, predicted, hits, precision, recall and F1 (0 where undefined)."""
    counts = confusion_counts(df, label, prediction)
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(F.lit(0))
    sides = F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted"), hit.alias("hits")),
        F.struct(F.col("prediction").cast(df.schema[label].dataType).alias("class"),
                 F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("hits")),
    )
    per_class = counts.select(F.inline(sides)).groupBy("class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"),
        F.sum("hits").alias("hits"))
    return per_class.withColumns({
        "precision": _ratio(F.col("hits"), F.col("predicted")),
        "recall": _ratio(F.col("hits"), F.col("support")),
        "f1": _ratio(2.0 * F.col("hits"), F.col("support") + F.col("predicted")),
    })


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row with every class metric; Catalyst drops the ones not selected."""
    c = class_table(df, label, prediction)
    support, predicted = F.col("support").cast("double"), F.col("predicted").cast("double")
    n, hits = F.sum(support), F.sum(F.col("hits").cast("double"))
    cross = F.sum(support * predicted)
    real, guess = F.sum(support * support), F.sum(predicted * predicted)
    spread = F.sqrt((n * n - guess) * (n * n - real))
    present = F.col("support") > 0
    expected = cross / n
    return c.agg(
        (hits / n).alias("accuracy"),
        F.avg(F.when(present, F.col("recall"))).alias("balanced_accuracy"),
        (F.sum(F.col("f1") * support) / n).alias("f1_weighted"),
        F.avg("f1").alias("f1_macro"),
        (hits / n).alias("f1_micro"),
        (F.sum(F.col("precision") * support) / n).alias("precision_weighted"),
        (F.sum(F.col("recall") * support) / n).alias("recall_weighted"),
        _ratio(hits * n - cross, F.nullif(spread, F.lit(0.0))).alias("mcc"),
        _ratio(hits - expected, F.nullif(n - expected, F.lit(0.0))).alias("cohen_kappa"),
    )


def binary_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall and F1 of class 1."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    counts = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                    F.count_if(y & ~p).alias("fn"))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return counts.select(
        _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
        _ratio(2.0 * tp, 2 * tp + fp + fn).alias("f1"))


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Every pair of classes with its count and its share of the true class."""
    counts = confusion_counts(df, label, prediction)
    sides = counts.select(F.explode(F.array("label", F.col("prediction").cast(
        df.schema[label].dataType))).alias("c"), "label", "n")
    classes = sides.groupBy("c").agg(
        F.coalesce(F.sum(F.when(F.col("c") == F.col("label"), F.col("n"))), F.lit(0)).alias("_"))
    names = [r.c for r in classes.select("c").distinct().orderBy("c").collect()]
    grid = classes.select(
        F.col("c").alias("label"), F.explode(F.array(*[F.lit(v) for v in names])).alias("prediction"))
    totals = counts.groupBy("label").agg(F.sum("n").alias("total"))
    out = grid.join(counts, ["label", "prediction"], "left").join(totals, "label", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select("label", "prediction", n.alias("n"),
                      F.round(_ratio(n * 100.0, F.col("total")), 4).alias("row_pct"))


# -- ranking metrics -----------------------------------------------------------------------------

def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score; hot scores shrink to one row here."""
    y = F.col(label).cast("double")
    return df.filter(F.col(score).isNotNull()).groupBy(F.col(score).alias("score")).agg(
        F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg"))


def score_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """Distinct scores, highest first, with true and false positives at or above each."""
    counts = score_counts(df, label, score)
    return running_sums(counts, [F.desc("score")], {"pos": "tp", "neg": "fp"})


def ranking_metrics(df: DataFrame, label: str, score: str) -> DataFrame:
    """Exact area under the ROC curve (tied scores count half) and average precision.

    Average precision is the sum over scores of the recall gained times the precision there.
    """
    curve = score_curve(df, label, score)
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    size = F.sum("pos").cast("double") * F.sum("neg")
    step = F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")).cast("double"))
    return curve.agg(
        F.try_divide(area, size).alias("roc_auc"),
        F.try_divide(F.sum(step), F.sum("pos")).alias("average_precision"))


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    return ranking_metrics(df, label, score).select("roc_auc")


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    return ranking_metrics(df, label, score).select("average_precision")


def roc_auc_multiclass(df: DataFrame, label: str, scores: dict[str, str]) -> DataFrame:
    """One-vs-rest area per class, weighted by support; ``scores`` maps a class to its column.

    All classes are ranked in one ordering: the class is the first sort key.
    """
    sides = F.array(*[
        F.struct(F.lit(c).alias("class"), F.col(s).alias("score"),
                 (F.col(label).cast("string") == F.lit(c)).cast("int").alias("y"))
        for c, s in scores.items()])
    counts = df.select(F.inline(sides)).groupBy("class", "score").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    ranked = running_sums(counts, ["class", F.desc("score")], {"pos": "tp"})
    start = ranked.groupBy("class").agg(F.min(F.col("tp") - F.col("pos")).alias("base"))
    areas = ranked.join(start, "class").groupBy("class").agg(
        F.sum(F.col("neg") * (F.col("tp") - F.col("base") - F.col("pos") / 2.0)).alias("area"),
        F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    auc = F.try_divide(F.col("area"), F.col("p").cast("double") * F.col("q"))
    return areas.agg(F.try_divide(F.sum(auc * F.col("p")), F.sum("p")).alias("roc_auc"))


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """False and true positive rate at each distinct score."""
    curve = score_curve(df, label, score)
    total = score_counts(df, label, score).agg(F.sum("pos").alias("p"), F.sum("neg").alias("q")).first()
    return curve.select(
        F.col("score").alias("threshold"),
        F.round(_ratio(F.col("fp"), F.lit(total.q)), 6).alias("fpr"),
        F.round(_ratio(F.col("tp"), F.lit(total.p)), 6).alias("tpr"))


def pr_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """Precision and recall at each distinct score, with the positive rate as the baseline."""
    curve = score_curve(df, label, score)
    total = score_counts(df, label, score).agg(F.sum("pos").alias("p"), F.sum("neg").alias("q")).first()
    p, q = total.p or 0, total.q or 0
    return curve.select(
        F.col("score").alias("threshold"),
        F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"),
        F.round(_ratio(F.col("tp"), F.lit(p)), 6).alias("recall"),
        F.round(F.lit(p / (p + q) if p + q else 0.0), 6).alias("baseline"))


# -- regression ----------------------------------------------------------------------------------

# Smallest denominator of the percentage error: the spacing of doubles at 1.
EPSILON = 2.220446049250313e-16


def regression_metrics(df: DataFrame, actual: str, predicted: str, features: int = 1) -> DataFrame:
    """One row with every regression metric except the median error."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    e = y - p
    n = F.count(e).cast("double")
    r2 = 1.0 - F.try_divide(F.sum(e * e), F.var_pop(y) * n)
    return df.agg(
        r2.alias("r2"),
        (1.0 - (1.0 - r2) * F.try_divide(n - 1.0, n - F.lit(features + 1.0))).alias("adjusted_r2"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(EPSILON))).alias("mape"),
        F.max(F.abs(e)).alias("max_error"),
        (1.0 - F.try_divide(F.var_pop(e), F.var_pop(y))).alias("explained_variance"),
    )


def median_absolute_error(df: DataFrame, actual: str, predicted: str,
                          approximate: bool = False) -> DataFrame:
    e = df.select(F.abs(F.col(actual).cast("double") - F.col(predicted).cast("double")).alias("e"))
    return quantiles(e, [], "e", [0.5], approximate).select(F.col("quantile").alias("median_ae"))


def fit_line(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Best-fit line of actual against predicted values with R2 and RMSE."""
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    return df.agg(
        F.regr_slope(p, y).alias("slope"), F.regr_intercept(p, y).alias("intercept"),
        (1.0 - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y - p))).alias("r2"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), F.count(y - p).alias("n"))


def residuals(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    return df.withColumn("residual", F.col(actual) - F.col(predicted))


def overfit_gap(scores: DataFrame, train: str = "train_score", test: str = "test_score") -> DataFrame:
    """Train minus test score, and HIGH above 0.10, MODERATE above 0.05, otherwise GOOD."""
    gap = F.col(train) - F.col(test)
    level = F.when(gap > 0.10, "HIGH").when(gap > 0.05, "MODERATE").otherwise("GOOD")
    return scores.withColumns({"gap": gap, "overfit": level})


# Metrics for which a smaller value is the better one.
SMALLER_IS_BETTER = ("mae", "mse", "rmse", "mape", "median_ae", "max_error", "davies_bouldin")


def best_first(metric: str, column: str) -> Column:
    return F.asc_nulls_last(column) if metric in SMALLER_IS_BETTER else F.desc_nulls_last(column)
