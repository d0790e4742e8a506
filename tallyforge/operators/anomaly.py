"""Labels, summaries and explanations of anomaly scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.quantiles import quantiles


def label_by_share(df: DataFrame, score: str, contamination: float = 0.05, approximate: bool = False,
                   out: str = "is_anomaly") -> DataFrame:
    """Flags the rows whose score lies above the (1 - contamination) quantile."""
    row = quantiles(df, [], score, [1.0 - contamination], approximate).first()
    limit = row["quantile"] if row else None
    return df.withColumn(out, F.coalesce(F.col(score) > F.lit(limit), F.lit(False)).cast("int"))


def summary(df: DataFrame, flag: str = "is_anomaly") -> DataFrame:
    counts = df.agg(F.count("*").alias("total"), F.sum(flag).cast("bigint").alias("anomalies"))
    return counts.select(
        "total", "anomalies", (F.col("total") - F.col("anomalies")).alias("normal"),
        F.round(F.try_divide(F.col("anomalies") * 100.0, F.col("total")), 4).alias("anomaly_pct"))


def top(df: DataFrame, score: str, key: str, n: int = 200) -> DataFrame:
    return df.orderBy(F.desc(score), key).limit(n)


def timeline(df: DataFrame, time: str, value: str, score: str, flag: str = "is_anomaly") -> DataFrame:
    """The series in time order with its anomalies marked."""
    return df.select(time, value, score, flag,
                     F.when(F.col(flag) == 1, F.col(value)).alias("anomaly_value")).orderBy(time)


def importance(df: DataFrame, columns: list[str], flag: str = "is_anomaly", approximate: bool = False) -> DataFrame:
    """How far the medians of anomalies and normal rows lie apart, in interquartile ranges.

    With only one kind of row the deviation of each column stands in.
    """
    long = df.select(F.col(flag).alias("_flag"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        ["_flag"], list(columns), "feature", "x")
    kinds = df.agg(F.min(flag).alias("a"), F.max(flag).alias("b")).first()
    if kinds.a == kinds.b:
        return long.groupBy("feature").agg(F.coalesce(F.stddev_pop("x"), F.lit(0.0)).alias("importance")).orderBy(
            F.desc("importance"), "feature")
    # the overall quartiles and the medians of the two kinds, ranked together as three groups
    copies = F.array(F.lit("all"), F.when(F.col("_flag") == 1, "anomaly").otherwise("normal"))
    grouped = long.withColumn("_kind", F.explode(copies))
    q = quantiles(grouped, ["_kind", "feature"], "x", [0.25, 0.5, 0.75], approximate)
    pick = lambda kind, p: F.max(F.when(
        (F.col("_kind") == kind) & (F.col("prob") == p), F.col("quantile")))
    spread = F.abs(pick("all", 0.75) - pick("all", 0.25)) + F.lit(1e-9)
    gap = F.abs(pick("anomaly", 0.5) - pick("normal", 0.5))
    return q.groupBy("feature").agg(F.coalesce(gap / spread, F.lit(0.0)).alias("importance")).orderBy(
        F.desc("importance"), "feature")
