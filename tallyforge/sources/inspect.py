"""Checks and facts about a loaded table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.columns import dtype_family


def validate(df: DataFrame, target: str | None = None, extension: str | None = None) -> DataFrame:
    """One row per rule: at least 10 rows, 2 columns, and 20 rows that have a target."""
    present = F.count(F.col(target)) if target else F.count("*")
    counts = df.agg(F.count("*").alias("n"), present.alias("k"))
    width = len(df.columns)
    known = extension is None or extension.lower().lstrip(".") in ("csv", "data", "txt")
    checks = {
        "not_empty": (F.col("n") > 0, F.col("n")),
        "min_rows": (F.col("n") >= 10, F.col("n")),
        "min_columns": (F.lit(width >= 2), F.lit(width).cast("bigint")),
        "file_type": (F.lit(known), F.lit(int(known)).cast("bigint")),
        "min_target_rows": (F.col("k") >= 20, F.col("k")),
    }
    rules = F.array(*[
        F.struct(F.lit(rule).alias("rule"), ok.alias("ok"), detail.alias("detail"))
        for rule, (ok, detail) in checks.items()
    ])
    return counts.select(F.inline(rules)).select(
        "rule", F.col("ok").cast("int").alias("passed"), "detail")


def metadata(df: DataFrame) -> DataFrame:
    """One row per column: position, type family, rows and missing values."""
    counts = df.agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)])
    entries = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                 F.lit(dtype_family(f.dataType)).alias("dtype"),
                 F.col("n_rows").alias("n_rows"), F.col(f"m{i}").alias("missing"))
        for i, f in enumerate(df.schema.fields)
    ])
    return counts.select(F.inline(entries))


def stored_bytes(df: DataFrame) -> int:
    """Size of the files behind a table."""
    files = df.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s"))
    return files.distinct().agg(F.sum("s").alias("s")).first().s or 0


def preview(df: DataFrame, key: str, rows: int = 5) -> DataFrame:
    """The first rows by key."""
    return df.orderBy(key).limit(rows)
