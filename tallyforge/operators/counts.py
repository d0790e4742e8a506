"""Value counts of many columns in one shuffle, and the per-column facts derived from them.

Several ``countDistinct`` in one aggregate make Spark expand every row once per column and
still shuffle all distinct values. Counting ``(column, value)`` pairs gives distinct counts,
modes and mode shares for all columns at the same price, with map-side pre-aggregation, so a
value that fills a third of a column costs one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tallyforge.functions.columns import families, scalar_columns

# Columns are counted in their own type; text is made of the distinct values only.
_COMMON = {"integer": "bigint", "float": "double", "string": "string", "boolean": "boolean",
           "datetime": "timestamp_ntz"}


# Longer texts are counted by their 128-bit digest where only the number of values matters.
LONG_TEXT = 64


def _typed_counts(df: DataFrame, columns: Sequence[str], digest: bool = False) -> list[DataFrame]:
    """Rows ``(column, value, n)`` per type family, missing values kept as null."""
    kind = families(df)
    out = []
    for family, common in _COMMON.items():
        names = [c for c in columns if kind[c] == family]
        if names:
            cells = {c: F.col(c).cast(common) for c in names}
            if digest and family == "string":
                cells = {c: F.when(F.length(x) > LONG_TEXT, F.md5(x)).otherwise(x) for c, x in cells.items()}
            typed = df.select([x.alias(c) for c, x in cells.items()])
            long = typed.unpivot([], names, "column", "value")
            out.append(long.groupBy("column", "value").agg(F.count("*").alias("n")))
    return out


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows ``(column, value, n)`` of all columns, values as strings."""
    columns = list(columns or scalar_columns(df))
    parts = [
        part.select("column", F.col("value").cast("string").alias("value"), "n")
        for part in _typed_counts(df, columns)
    ]
    return reduce(DataFrame.unionByName, parts)


def column_facts(df: DataFrame, columns: Sequence[str] | None = None, digest: bool = True) -> DataFrame:
    """One row per column: n_rows, n_missing, nunique, mode and mode_count.

    The mode is the most frequent value and the smallest one on a tie. With ``digest`` long texts
    do not travel, and a mode that is a long text is given by its digest.
    """
    columns = list(columns or scalar_columns(df))
    present = F.col("value").isNotNull()
    ranked = F.when(present, F.struct((-F.col("n")).alias("neg"), F.col("value").alias("value")))
    parts = [
        counts.groupBy("column")
        .agg(
            F.sum("n").alias("n_rows"),
            F.sum(F.when(present, F.lit(0)).otherwise(F.col("n"))).alias("n_missing"),
            F.count("value").alias("nunique"),
            F.min(ranked).alias("_top"),
        )
        .select(
            "column", "n_rows", "n_missing", "nunique",
            F.col("_top.value").cast("string").alias("mode"),
            F.coalesce(-F.col("_top.neg"), F.lit(0)).cast("bigint").alias("mode_count"),
        )
        for counts in _typed_counts(df, columns, digest)
    ]
    return reduce(DataFrame.unionByName, parts)


def collect_facts(df: DataFrame, columns: Sequence[str] | None = None, digest: bool = True) -> dict[str, Row]:
    """The facts by column name; one row per column, so as small as the schema."""
    columns = list(columns if columns is not None else scalar_columns(df))
    if not columns:
        return {}
    found = {row["column"]: row for row in column_facts(df, columns, digest).collect()}
    empty = Row("column", "n_rows", "n_missing", "nunique", "mode", "mode_count")
    return {c: found.get(c, empty(c, 0, 0, 0, None, 0)) for c in columns}
