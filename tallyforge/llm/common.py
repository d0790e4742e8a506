"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.session import shared_folder


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: computed once, no lineage,
    columns pruned by later readers, and safe when executors are lost."""
    spark = df.sparkSession
    path = os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that Spark hands to a Python worker at once; ten thousand long texts would fill its memory.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder, for jobs over long texts."""
    short_batches(spark)
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def held_out(key: str | Column) -> Column:
    """The rows kept from learning: CRC-32 of the id as text leaves 2 modulo 4."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def copies_of(df: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Only the named columns; a name that the table has in another case is not confused with them."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def numbered_columns(df: DataFrame) -> DataFrame:
    """The columns as ``c0``, ``c1``, ..., so that none is named like those an operator adds."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def named_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The numbered columns under their names again; others are dropped."""
    return df.select(*[F.col(f"c{i}").alias(name) for i, name in enumerate(names)])


#: A group with more than this share of all rows is met by broadcast, so there are fewer than its inverse.
HOT_SHARE = 1 / 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with the row of their group, whatever the share of one group.

    ``size`` counts a group's rows and ``total`` is at least their sum, so fewer than 1000 groups
    exceed ``HOT_SHARE``; those are broadcast and their rows stay where they are. The others are
    joined by shuffle, none of them large. ``groups`` is read twice and should be stored.
    """
    border = max(1.0, total * HOT_SHARE)
    hot, rest = groups.filter(F.col(size) > border), groups.filter(F.col(size) <= border)
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(rest, key))
