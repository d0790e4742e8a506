"""Drift checks and scoring over arriving files.

Both streams read new files of a folder and stop when there are none left (``availableNow``);
the checkpoint remembers what was read, so a restart adds nothing twice.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyforge.operators.drift import paired_profiles, report_of, shared_numeric, value_profile
from tallyforge.operators.registry import Bundle, check_columns, scored_by
from tallyforge.session import materialise


def file_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int | None = 1) -> DataFrame:
    """New files of a folder; with ``files_per_batch`` None all that wait make one batch."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def drift_stream(spark: SparkSession, reference: DataFrame, folder: str, out: str, checkpoint: str,
                 files_per_batch: int | None = 1, profile: DataFrame | None = None) -> None:
    """Compares every arriving batch with the reference table, whose profile is counted once; a caller
    that runs the stream repeatedly hands it over as ``profile``.

    Each batch writes its report to its own folder, so a batch that is run again after a failure
    replaces its report. A batch without rows has an empty report.
    """
    profile = materialise(value_profile(reference)) if profile is None else profile

    def report(batch: DataFrame, number: int) -> None:
        arrived = value_profile(batch, shared_numeric(reference, batch))
        found = report_of(paired_profiles(profile, arrived)).withColumn("batch", F.lit(number))
        found.coalesce(1).write.mode("overwrite").parquet(os.path.join(out, f"report-{number}"))

    stream = file_stream(spark, folder, reference.schema, files_per_batch)
    query = stream.writeStream.foreachBatch(report).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def read_reports(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(out)


def score_stream(spark: SparkSession, bundle: Bundle, folder: str, schema: StructType, out: str,
                 checkpoint: str, keep: list[str], files_per_batch: int = 1) -> None:
    """Scores arriving files with a stored model and appends the scored rows.

    A model that scores row by row is part of the stream, and the file sink writes each row once. One
    that needs tables (neighbours) scores every micro-batch as a table; a repeated batch replaces what
    it had written.
    """
    stream = file_stream(spark, folder, schema, files_per_batch)
    check_columns(stream, bundle)
    model = bundle.load()
    columns = [*keep, "prediction", "score"]
    if any(getattr(s, "whole_tables", False) for s in model.stages):
        def score(batch: DataFrame, number: int) -> None:
            rows = scored_by(model, batch).select(*columns)
            rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

        writer = stream.writeStream.foreachBatch(score)
    else:
        writer = scored_by(model, stream).select(*columns).writeStream.format("parquet").outputMode("append").option("path", out)
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
