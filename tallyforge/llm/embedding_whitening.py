"""Whitening of embeddings by a weighted multiplicity covariance.

Entries become whole numbers (``floor(scale * entry)``); equal vectors are one row of the fit list
with the number of their copies. Each counts once, or as often as it has copies (``weights``). Counts
and sums are exact. The covariance is a weighted product of centred rows, one matrix a task, added up
by matrix row; its decomposition is the only work on the driver (a matrix of the dimension squared).
Every distinct vector is whitened once and joined back to its rows.

Defined results: rows whose vector is null, empty, or holds a null, NaN or infinite entry, or one whose
whole number is beyond 2**53 (no exact double), are left out, and so are vectors of another length than
the most frequent one (of equally frequent ones, the longest). Null and repeated ids are rows like
others. A component whose eigenvalue is zero up to rounding cannot be whitened: ``whitened`` is null
and ``explained`` 0 (null if there is no variance at all). ``deviation`` is exact; beyond 38 digits it
is null. Extra columns are ignored; an empty table gives no rows. One matrix of the dimension squared
has to fit a task.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import join_groups, stored

SCALE = 256
LARGEST = 2.0 ** 53  # whole numbers up to here are exact as doubles
#: Eigenvalues below this share of the largest are rounding.
LEAST_SHARE = 1e-12


@dataclass
class Whitening:
    """What the fit list says: weight, sums and decomposition; the same for all rows."""

    size: int  # total weight of the fit list
    sums: list[int]  # exact weighted sums per dimension
    axes: np.ndarray  # dimension x components, unit columns
    values: np.ndarray  # their eigenvalues
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.size for s in self.sums])


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``id, x, key`` of the rows with a usable vector; ``key`` is the SHA-256 of ``x``."""
    raw = F.col("raw")
    usable = (F.size(raw) > 0) & F.forall(raw, lambda c: F.coalesce(
        ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * scale <= LARGEST), F.lit(False)))
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("raw")).filter(raw.isNotNull() & usable)
    entries = F.transform(raw, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    rows = rows.select("id", entries.alias("x"))
    return rows.withColumn("key", F.unhex(F.sha2(F.array_join("x", ",").cast("binary"), 256)))


def usual_length(rows: DataFrame) -> int:
    """The most frequent length; 0 without rows."""
    lengths = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1)
    first = lengths.first()
    return first["length"] if first else 0


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column whose lists all have ``width`` entries."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def fit_list(rows: DataFrame, weights: str) -> DataFrame:
    """``key, x, copies, weight``: every distinct vector once."""
    if weights not in ("one", "counts"):
        raise ValueError("weights are 'one' or 'counts'")
    lists = rows.groupBy("key", "x").agg(F.count("*").alias("copies"))
    return lists.withColumn("weight", F.col("copies") if weights == "counts" else F.lit(1).cast("long"))


def totals(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """Weight and weighted sums of the fit list, exact; one row a task and dimension, added up by Spark."""
    def run(batches):
        size, sums = 0, [0] * width
        for batch in batches:
            x, weight = matrix(batch.column(0), width), batch.column(1).to_numpy()
            size += int(weight.sum())
            if float(np.abs(x).max(initial=0)) * float(weight.sum()) < 2.0 ** 62:
                part = (x * weight[:, None]).sum(axis=0).tolist()
            else:  # beyond a long: Python's whole numbers
                part = (x.astype(object) * weight.astype(object)[:, None]).sum(axis=0).tolist()
            sums = [a + b for a, b in zip(sums, part)]
        if size:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(width), pa.int32()), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0)),
                 pa.array([size] * width, pa.int64())], ["dim", "part", "size"])

    parts = fit.select("x", "weight").mapInArrow(run, "dim int, part decimal(38,0), size long")
    found = parts.groupBy("dim").agg(F.sum("part").alias("total"), F.sum("size").alias("size")).collect()
    ordered = sorted(found, key=lambda r: r["dim"])
    return (int(ordered[0]["size"]) if ordered else 0), [int(r["total"]) for r in ordered]


def covariance(fit: DataFrame, mean: np.ndarray, size: int) -> np.ndarray:
    """Weighted covariance about ``mean`` with divisor ``size``: rows are centred, then multiplied."""
    width = len(mean)

    def product(batches):
        out = np.zeros((width, width))
        for batch in batches:
            centred = matrix(batch.column(0), width) - mean
            out += (centred * batch.column(1).to_numpy()[:, None]).T @ centred
        yield rows_of(range(width), out)

    def rows_of(dims, values):
        return pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(list(values), pa.list_(pa.float64()))], ["dim", "part"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            parts = matrix(batch.column(1), width)
            for dim, part in zip(batch.column(0).to_pylist(), parts):
                sums[dim] = sums.get(dim, 0.0) + part
        yield rows_of(list(sums), sums.values())

    schema = "dim int, part array<double>"
    parts = fit.select("x", "weight").mapInArrow(product, schema).repartition("dim").mapInArrow(add, schema)
    out = np.zeros((width, width))
    for r in parts.collect():
        out[r["dim"]] = r["part"]
    return (out + out.T) / (2 * size)


def fit_whitening(fit: DataFrame, width: int, components: int) -> Whitening | None:
    """None if the fit list is empty."""
    size, sums = totals(fit, width)
    if not size:
        return None
    mean = np.array([s / size for s in sums])
    found = covariance(fit, mean, size)
    values, axes = np.linalg.eigh(found)
    order = np.argsort(values)[::-1][:components]
    return Whitening(size, sums, axes[:, order], values[order], float(np.trace(found)))


def whiten_distinct(fit: DataFrame, model: Whitening) -> DataFrame:
    """``key, copies, weight, deviation, whitened`` (one entry a component, null where its eigenvalue
    is zero) of every distinct vector."""
    mean, size, width = model.mean, model.size, len(model.sums)
    sums = np.array(model.sums, dtype=object)
    positive = model.values > max(model.values.max(initial=0.0), 0.0) * LEAST_SHARE
    scaled = model.axes / np.sqrt(np.where(positive, model.values, 1.0))
    limit = Decimal(10) ** 38

    def deviations(x):
        reach = (float(np.abs(x).max(initial=0)) * size + float(max(abs(s) for s in sums))) ** 2 * width
        if reach < 2.0 ** 62:
            return pa.array(((x * size - sums.astype(np.int64)) ** 2).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
        exact = [Decimal(int(d)) for d in ((x.astype(object) * size - sums) ** 2).sum(axis=1)]
        return pa.array([d if d < limit else None for d in exact], pa.decimal128(38, 0))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1), width)
            white = (x - mean) @ scaled
            flat = pa.array(white.ravel(), pa.float64(), mask=~np.broadcast_to(positive, white.shape).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * white.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), deviations(x), lists],
                ["key", "copies", "weight", "deviation", "whitened"])

    return fit.select("key", "x", "copies", "weight").mapInArrow(
        run, "key binary, copies long, weight long, deviation decimal(38,0), whitened array<double>")


def identity_error(white: DataFrame, components: int) -> float | None:
    """Largest entry of the whitened rows' covariance minus the identity, over the components that
    have variance; null if none has."""
    weight, total = F.col("weight"), F.sum("weight")
    entry = [F.col("whitened")[k] for k in range(components)]
    means = white.agg(*[(F.sum(entry[k] * weight) / total).alias(f"m{k}") for k in range(components)]).first()
    known = [k for k in range(components) if means[f"m{k}"] is not None]
    if not known:
        return None
    products = white.agg(*[(F.sum((entry[i] - means[f"m{i}"]) * (entry[j] - means[f"m{j}"]) * weight) / total).alias(f"c{i}_{j}")
                           for i in known for j in known if i <= j]).first()
    return max(abs(products[f"c{i}_{j}"] - (i == j)) for i in known for j in known if i <= j)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 4,
           weights: str = "one", scale: int = SCALE) -> DataFrame:
    """One row per usable row and component (numbered from 1 by falling eigenvalue): id, ``component``,
    ``n`` (weight of the fit list), ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    rows = stored(whole_vectors(df, id_col, vector_col, scale), "whole-vectors")
    width = usual_length(rows)
    rows = rows.filter(F.size("x") == width)
    fit = stored(fit_list(rows, weights), "fit-list")
    model = fit_whitening(fit, width, min(components, width)) if width else None
    if model is None:
        return df.sparkSession.createDataFrame([], f"""`{id_col}` {df.schema[id_col].dataType.simpleString()},
            component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double""")
    white = stored(whiten_distinct(fit, model), "whitened")
    error = identity_error(white, len(model.values))
    total = fit.agg(F.sum("copies")).first()[0]
    each = join_groups(rows.select("id", "key"), white, "key", "copies", total)
    share = [max(float(v), 0.0) if v > model.values.max(initial=0.0) * LEAST_SHARE else 0.0 for v in model.values]
    explained = F.array(*[F.lit(s / model.trace if model.trace > 0 else None).cast("double") for s in share])
    return each.select("id", "deviation", F.posexplode("whitened").alias("place", "white")).select(
        F.col("id").alias(id_col), (F.col("place") + 1).cast("int").alias("component"), F.lit(model.size).cast("long").alias("n"),
        "deviation", F.col("white").alias("whitened"), F.element_at(explained, F.col("place") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))
