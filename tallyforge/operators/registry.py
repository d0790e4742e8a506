"""Fingerprints, stored models and batch scoring."""

from __future__ import annotations

import hashlib
import json
import os
import time
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.learners import ScoreScale, with_score

REGISTRY_SCHEMA = (
    "signature string, name string, task string, path string, features string, metrics string, "
    "config string, trained_at timestamp_ntz")


def fingerprint(df: DataFrame) -> str:
    """Hash of the rows, whatever their order or layout, and of the schema."""
    h = F.xxhash64(F.struct(*[F.col(c) for c in df.columns]))
    row = df.select(h.alias("h")).agg(
        F.count("*").alias("n"), F.bit_xor("h").alias("x"),
        F.sum(F.pmod("h", F.lit(2_147_483_647))).alias("s"),
        F.sum(F.pmod(F.shiftright("h", 17), F.lit(2_147_483_647))).alias("t")).first()
    text = f"{df.schema.simpleString()}|{row.n}|{row.x}|{row.s}|{row.t}"
    return hashlib.sha256(text.encode()).hexdigest()


def signature(data: str, task: str, name: str, config: dict) -> str:
    text = json.dumps([data, task, name, config], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass
class Bundle:
    signature: str
    name: str
    task: str
    path: str
    features: list[str]
    metrics: dict
    config: dict
    reused: bool = False

    def load(self):
        return PipelineModel.load(self.path)


class Registry:
    """A folder of stored pipeline models and one table that describes them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.table = os.path.join(folder, "registry")
        self.fitted: dict = {}  # models that this object has trained, by path

    def entries(self) -> DataFrame:
        return self.spark.read.schema(REGISTRY_SCHEMA).option("recursiveFileLookup", "true").parquet(self.table)

    def find(self, sign: str) -> Bundle | None:
        """The latest model with this signature."""
        try:
            row = (
                self.entries().filter(F.col("signature") == sign)
                .orderBy(F.desc("trained_at"), "path").limit(1).first())
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise
        if row is None:
            return None
        return Bundle(row.signature, row.name, row.task, row.path, json.loads(row.features),
                      json.loads(row.metrics), json.loads(row.config), reused=True)

    def train(self, df: DataFrame, pipeline, name: str, task: str, features: list[str], config: dict,
              evaluate=None, force: bool = False) -> Bundle:
        """Fits and stores the pipeline, or returns the stored one for the same data and settings."""
        sign = signature(fingerprint(df), task, name, config)
        known = None if force else self.find(sign)
        if known:
            return known
        model = pipeline.fit(df)
        return self.put(model, df, sign, name, task, features, config, evaluate)

    def put(self, model, df: DataFrame, sign: str, name: str, task: str, features: list[str], config: dict, evaluate=None) -> Bundle:
        """Stores a fitted model together with the scale of its scores over the training rows ``df``."""
        stages = model.stages if isinstance(model, PipelineModel) else [model]
        if not any(isinstance(s, ScoreScale) for s in stages):
            scored = PipelineModel(stages).transform(df)
            model = PipelineModel([*stages, ScoreScale.fit(scored)])
        found = evaluate(model.transform(df)) if evaluate else {}
        path = os.path.join(self.folder, "models", f"{sign[:16]}-{time.time_ns()}")
        model.write().overwrite().save(path)
        self.fitted[path] = model
        bundle = Bundle(sign, name, task, path, list(features), found, config)
        row = [(sign, name, task, path, json.dumps(bundle.features), json.dumps(found), json.dumps(config, default=str))]
        self.spark.createDataFrame(
            row, "signature string, name string, task string, path string, features string, metrics string, config string",
        ).withColumn("trained_at", F.localtimestamp()).coalesce(1).write.mode("append").parquet(self.table)
        return bundle


def check_columns(df: DataFrame, bundle: Bundle) -> None:
    missing = [c for c in bundle.features if c not in df.columns]
    if missing:
        raise ValueError(f"missing feature columns: {missing}")


def scored_by(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Predictions with the score of the stored scale."""
    out = model.transform(df)
    return out if any(isinstance(s, ScoreScale) for s in model.stages) else with_score(out)


def score_batch(df: DataFrame, bundle: Bundle) -> DataFrame:
    """Predictions of a stored model with the score; partitioning does the chunking. The score of a row
    does not depend on the rows beside it."""
    check_columns(df, bundle)
    return scored_by(bundle.load(), df)
