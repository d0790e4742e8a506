"""Fitted models of this library as pipeline stages that Spark can write and read.

A ``StoredModel`` states its contents in three parts: ``facts`` (names and settings, written as JSON
beside the stage's metadata), ``tables`` (parameters, nodes, training rows; one Parquet table each) and
``models`` (fitted Spark or library models, each in a folder of its own). That is all a subclass has to
say: it can then stand in a ``PipelineModel`` together with Spark's own stages, be written with it and
be read back in another session.
"""

from __future__ import annotations

import json
import os

import numpy as np
from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession

ARRAY_SCHEMA = "name string, place int, shape array<int>, numbers array<double>"


class StoredModel(Model, MLWritable, MLReadable):
    """Base of the fitted models. Subclasses give ``contents``, ``restored`` and ``_transform``."""

    #: Whether scoring needs the rows as a table (joins and groups of its own), not row by row.
    whole_tables = False

    def contents(self, spark: SparkSession) -> tuple[dict, dict[str, DataFrame], dict[str, Model]]:
        raise NotImplementedError

    @classmethod
    def restored(cls, facts: dict, tables: dict[str, DataFrame], models: dict[str, Model]) -> "StoredModel":
        raise NotImplementedError

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, model: StoredModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        facts, tables, models = self.model.contents(self.sparkSession)
        extra = {"facts": json.loads(json.dumps(facts, default=str)), "tables": sorted(tables), "models": sorted(models)}
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession, extraMetadata=extra)
        for name, table in tables.items():
            table.write.parquet(os.path.join(path, "tables", name))
        for name, model in models.items():
            model.write().save(os.path.join(path, "models", name))


class _Reader(MLReader):
    def __init__(self, kind: type[StoredModel]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> StoredModel:
        spark = self.sparkSession
        known = DefaultParamsReader.loadMetadata(path, spark)
        tables = {n: spark.read.parquet(os.path.join(path, "tables", n)) for n in known["tables"]}
        models = {n: DefaultParamsReader.loadParamsInstance(os.path.join(path, "models", n), spark) for n in known["models"]}
        return self.kind.restored(known["facts"], tables, models)._resetUid(known["uid"])


def array_table(spark: SparkSession, **arrays: np.ndarray) -> DataFrame:
    """Parameter arrays of any shape as rows, one for each entry of their first axis."""
    rows = [(name, i, list(np.shape(a)), np.asarray(part, float).ravel().tolist())
            for name, a in arrays.items() for i, part in enumerate(a)]
    return spark.createDataFrame(rows, ARRAY_SCHEMA)


def arrays_of(table: DataFrame) -> dict[str, np.ndarray]:
    """The arrays of ``array_table``; as large as the model, not as its training rows."""
    parts: dict[str, list] = {}
    for r in table.collect():
        parts.setdefault(r["name"], []).append((r["place"], r["shape"], r["numbers"]))
    return {name: np.array([p[2] for p in sorted(found, key=lambda p: p[0])]).reshape(found[0][1]) for name, found in parts.items()}
