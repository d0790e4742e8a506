"""What goes together with the target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.columns import nan_to_null, numeric_columns, string_columns
from tallyforge.operators.counts import collect_facts
from tallyforge.operators.roles import binary_target, with_codes


def churn_overview(df: DataFrame, target: str) -> DataFrame:
    y = binary_target(df, target)
    counts = df.agg(F.count("*").alias("total"), F.sum(y).cast("bigint").alias("churned"))
    return counts.select(
        "total", "churned", (F.col("total") - F.col("churned")).alias("retained"),
        F.round(F.try_divide(F.col("churned") * 100.0, F.col("total")), 4).alias("churn_rate_pct"))


def churn_by_category(df: DataFrame, target: str, max_levels: int = 20, max_columns: int | None = None) -> DataFrame:
    """Churn rate per level of the small string columns; levels without churn are left out."""
    strings = string_columns(df, exclude=[target])
    facts = collect_facts(df, strings)
    columns = [c for c in strings if facts[c].nunique <= max_levels][:max_columns]
    long = df.select(binary_target(df, target).alias("_y"), *columns).unpivot(
        ["_y"], columns, "column", "level").filter("level IS NOT NULL")
    rates = long.groupBy("column", "level").agg(F.count("*").alias("n"), F.sum("_y").cast("bigint").alias("churned"))
    return rates.filter("churned > 0").select(
        "column", "level", "n", "churned", F.round(F.col("churned") * 100.0 / F.col("n"), 4).alias("churn_pct"),
    ).orderBy("column", F.desc("churn_pct"))


def _correlations(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    """Correlation of each column with ``y`` and the number of complete pairs, in one aggregate."""
    if not columns:
        return df.sparkSession.createDataFrame([], "feature string, correlation double, n bigint")
    wide = df.agg(*[
        F.struct(F.corr(F.col(c).cast("double"), F.col(y).cast("double")).alias("correlation"),
                 F.count_if(F.col(c).isNotNull() & F.col(y).isNotNull()).alias("n")).alias(f"c{i}")
        for i, c in enumerate(columns)])
    entries = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"c{i}.correlation").alias("correlation"),
                 F.col(f"c{i}.n").alias("n")) for i, c in enumerate(columns)])
    return wide.select(F.inline(entries)).filter("correlation IS NOT NULL AND NOT isnan(correlation)")


def _strongest(found: DataFrame, top: int | None) -> DataFrame:
    r = F.col("correlation")
    out = found.select("feature", F.round(r, 6).alias("correlation"), F.round(F.abs(r), 6).alias("strength")).orderBy(
        F.desc("strength"), "feature")
    return out if top is None else out.limit(top)


def churn_correlations(df: DataFrame, target: str, top: int | None = None) -> DataFrame:
    """Pearson correlation with the 0/1 label; categories as their sorted codes."""
    df = nan_to_null(df)
    y = binary_target(df, target)
    coded = df.withColumn("_y", y)
    strings = string_columns(df, exclude=[target])
    for c in strings:
        coded = coded.withColumn(c, F.coalesce(F.col(c), F.lit("nan")))
        coded = with_codes(coded, c, f"_code_{c}").drop(c).withColumnRenamed(f"_code_{c}", c)
    columns = [c for c in df.columns if c in set(numeric_columns(df, exclude=[target])) | set(strings)]
    return _strongest(_correlations(coded, columns, "_y"), top)


def top_correlations(df: DataFrame, target: str, top: int | None = None) -> DataFrame:
    """Numeric columns most correlated with the target, over at least 8 complete pairs."""
    df = nan_to_null(df)
    coded = with_codes(df, target, "_y")
    columns = numeric_columns(df, exclude=[target])
    return _strongest(_correlations(coded, columns, "_y").filter("n >= 8"), top)


