"""From scores to decisions: thresholds, profit and error cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.operators.metrics import _ratio

# Business defaults.
OFFER_COST = 500.0
CUSTOMER_VALUE = 10_000.0
SUCCESS_RATE = 1.0
ERROR_UNIT_COST = 120.0
DECISIONS = 1000


def threshold_sweep(df: DataFrame, label: str, score: str, steps: int = 99) -> DataFrame:
    """Counts and metrics at ``steps`` thresholds from 0.01 to 0.99, in one pass.

    Each score is mapped to the last threshold it reaches, so a row is counted once and the
    thresholds are cumulated over the grid, not over the rows.
    """
    grid = [0.01 + 0.98 * i / (steps - 1) for i in range(steps)]
    grid = [round(v, 2) if steps == 99 else v for v in grid]
    # the arithmetic guess is corrected by comparing with the thresholds themselves
    table = F.array(*[F.lit(v) for v in grid])
    s = F.col(score).cast("double")
    guess = F.floor((s - F.lit(grid[0])) / F.lit(grid[1] - grid[0])).cast("int")
    guess = F.greatest(F.lit(-1), F.least(guess, F.lit(steps - 1)))
    up = F.when(s >= F.get(table, guess + 1), guess + 1).otherwise(guess)
    slot = F.when((up >= 0) & (s < F.get(table, up)), up - 1).otherwise(up)
    y = F.col(label).cast("double") == 1
    counts = df.filter(s.isNotNull()).groupBy(slot.alias("i")).agg(
        F.count_if(y).alias("p"), F.count_if(~y).alias("q"))
    rows = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(grid)], "i int, threshold double")
    # at most one row per threshold from here on, plus the one below all of them
    every = rows.join(counts, "i", "full").select(
        "i", "threshold", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("q", F.lit(0)).alias("q"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("i"))
    whole = Window.partitionBy(F.lit(0))
    swept = every.select(
        "threshold",
        F.sum("p").over(above).alias("tp"), F.sum("q").over(above).alias("fp"),
        F.sum("p").over(whole).alias("_p"), F.sum("q").over(whole).alias("_q"),
    ).filter("threshold IS NOT NULL")
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("_p") - tp, F.col("_q") - fp
    return swept.select(
        F.round("threshold", 6).alias("threshold"), "tp", "fp", fn.alias("fn"), tn.alias("tn"),
        F.round(_ratio(tp, tp + fp), 6).alias("precision"),
        F.round(_ratio(tp, tp + fn), 6).alias("recall"),
        F.round(_ratio(2.0 * tp, 2 * tp + fp + fn), 6).alias("f1"),
        F.round(_ratio(tp + tn, F.col("_p") + F.col("_q")), 6).alias("accuracy"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold with the highest F1, the lowest one on a tie."""
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1)


def profit_curve(sweep: DataFrame, offer_cost: float = OFFER_COST,
                 customer_value: float = CUSTOMER_VALUE,
                 success_rate: float = SUCCESS_RATE) -> DataFrame:
    revenue = F.col("tp") * F.lit(customer_value * success_rate)
    cost = (F.col("tp") + F.col("fp")) * F.lit(offer_cost)
    return sweep.select(
        "threshold", (F.col("tp") + F.col("fp")).alias("targeted"), revenue.alias("revenue"),
        cost.alias("cost"), (revenue - cost).alias("profit"))


def profit_optimum(curve: DataFrame) -> DataFrame:
    """The most profitable threshold, the lowest one on a tie."""
    return curve.orderBy(F.desc("profit"), "threshold").limit(1)


def error_cost(df: DataFrame, actual: str, predicted: str, unit_cost: float = ERROR_UNIT_COST,
               decisions: int = DECISIONS) -> DataFrame:
    """Mean absolute error and what it costs over a number of decisions."""
    return df.agg(F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("mae")).select(
        "mae", (F.col("mae") * F.lit(unit_cost) * F.lit(float(decisions))).alias("expected_cost"))
