"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

A text becomes counts of hashed words, of runs of three byte classes (its typography) and of words
that repeat a recent one. Damped, weighted by rarity and scaled to length one, a bounded labelled
sample is decomposed by a randomised singular value decomposition; its latent vectors and labels
go to the tasks, which take exact cosines of every document with all of them, block by block, and
weight the labels of the nearest by similarity.

Defined results: null counts as empty; an empty text has no neighbours and gets the share of label 1
as score, as does every text when nothing is labelled (0.5 then); ties between neighbours go to the
earlier sample row; repeated rows are scored alike; extra columns pass through. A text is read
whole; memory follows the longest one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.hashing import hash_unit
from tallyforge.llm.bytesets import LOWER_CODES, NOT_SPACE, blocks, flat, prefix_sums, substring_hashes, word_bounds

_CLASSES = 12
_WORDS = 2048
_REPEATS = 3
WIDTH = _CLASSES ** 3 + _WORDS + _REPEATS


def _class_table() -> np.ndarray:
    """Class of a byte: lower, upper, digit, blank, line end, other characters, punctuation."""
    out = np.full(256, 11, np.int64)
    out[97:123], out[65:91], out[48:58], out[128:] = 0, 1, 2, 5
    out[[32, 9]], out[[10, 13]] = 3, 4
    for kind, marks in ((6, b".,;:?'\"-"), (7, b"!"), (8, b"*#$%&@~^"), (9, b"|/\\_<>=+"), (10, b"()[]{}")):
        out[list(marks)] = kind
    return out


CLASS_OF = _class_table()


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Damped counts, one row per text; not yet weighted."""
    texts = len(offsets) - 1
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(texts), sizes)
    kinds = CLASS_OF[data]
    cells = []
    if len(data) > 2:
        inside = owner[:-2] == owner[2:]
        runs = kinds[:-2] * _CLASSES ** 2 + kinds[1:-1] * _CLASSES + kinds[2:]
        cells.append((owner[:-2] * WIDTH + runs)[inside])
    starts, ends, words = word_bounds(data, offsets, NOT_SPACE)
    if len(starts):
        hashed = substring_hashes(prefix_sums(data, LOWER_CODES), starts, ends)
        of = np.repeat(np.arange(texts), np.diff(words))
        cells.append(of * WIDTH + _CLASSES ** 3 + (hashed % np.uint64(_WORDS)).astype(np.int64))
        for k in range(1, _REPEATS + 1):
            again = (hashed[k:] == hashed[:-k]) & (of[k:] == of[:-k])
            cells.append(of[k:][again] * WIDTH + _CLASSES ** 3 + _WORDS + k - 1)
    counts = np.bincount(np.concatenate(cells) if cells else np.zeros(0, np.int64), minlength=texts * WIDTH)
    return np.sqrt(counts.reshape(texts, WIDTH)).astype(np.float32)


def feature_blocks(column: pa.Array):
    """(first text, features) of at most 256 texts at a time, some megabytes."""
    data, offsets = flat(column)
    for i, j in blocks(offsets):
        for a in range(i, j, 256):
            b = min(a + 256, j)
            yield a, features(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])


@dataclass
class NeighbourVote:
    """Projection, latent vectors of the sample, their labels, and the share of label 1."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int = 15
    power: int = 8

    def latent(self, rows: np.ndarray) -> np.ndarray:
        weighted = rows * self.weights
        out = weighted @ self.axes
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(rows), self.prior)
        empty = ~rows.any(axis=1)
        cosines = np.maximum(self.latent(rows) @ self.vectors.T, 0)
        k = min(self.neighbours, len(self.labels))
        near = nearest_columns(cosines, k)
        votes = np.take_along_axis(cosines, near, axis=1).astype(np.float64) ** self.power
        total = votes.sum(axis=1)
        score = (votes * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-300)
        return np.clip(np.where(empty | (total <= 0), self.prior, score), 0.0, 1.0)


def nearest_columns(cosines: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` columns of the largest cosines of every row; of equal ones at the border, the first."""
    border = np.partition(cosines, -k, axis=1)[:, [-k]]
    above, level = cosines > border, cosines == border
    missing = k - above.sum(axis=1, keepdims=True)
    tied = np.flatnonzero(level.sum(axis=1, keepdims=True) > missing)
    level[tied] &= np.cumsum(level[tied], axis=1) <= missing[tied]
    return np.nonzero(above | level)[1].reshape(len(cosines), k)


def _axes(rows: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors by a randomised range finder with power steps."""
    rng = np.random.default_rng(0)
    basis = rows.T @ rng.standard_normal((rows.shape[0], rank + 10)).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(rows.T @ (rows @ basis))
    _, _, v = np.linalg.svd(rows @ basis, full_matrices=False)
    return (basis @ v.T)[:, :rank].astype(np.float32)


def learn_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", sample_rows: int = 4000, rank: int = 96) -> NeighbourVote:
    """The model of the labelled documents, fitted on about ``sample_rows`` of them, half of each
    label as far as there are so many, chosen by a hash of the id. The sample is all that the driver
    and the tasks hold: some ten megabytes whatever the tables' size."""
    marked = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}
    if not counts:
        none = np.zeros((0, 0), np.float32)
        return NeighbourVote(none, none, none, np.zeros(0), 0.5)
    rate = F.lit(0.0)
    for label, n in counts.items():
        rate = F.when(F.col("label") == label, F.lit(min(1.0, sample_rows / 2 / n))).otherwise(rate)
    # the sample is bounded by sample_rows (in expectation, by a hash), so it may be broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(marked.filter(hash_unit("id", "quality") < rate)), "id")

    def sparse(batches):
        for batch in batches:
            ids, labels = batch.column(0), batch.column(2)
            for a, block in feature_blocks(batch.column(1)):
                cells = [np.flatnonzero(r) for r in block]
                yield pa.RecordBatch.from_arrays(
                    [ids[a:a + len(block)], labels[a:a + len(block)],
                     pa.array([c.astype(np.uint16).tobytes() for c in cells], pa.binary()),
                     pa.array([r[c].tobytes() for r, c in zip(block, cells)], pa.binary())],
                    ["id", "label", "cells", "counts"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("label", T.IntegerType()),
                           T.StructField("cells", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    sample = rows.mapInArrow(sparse, schema).collect()
    sample.sort(key=lambda r: (str(r["id"]), bytes(r["cells"])))
    matrix = np.zeros((len(sample), WIDTH), np.float32)
    for i, r in enumerate(sample):
        matrix[i, np.frombuffer(r["cells"], np.uint16)] = np.frombuffer(r["counts"], np.float32)
    votes = np.array([r["label"] for r in sample], np.float64)
    weights = (np.log((1 + len(sample)) / (1 + (matrix > 0).sum(axis=0))) + 1).astype(np.float32)
    matrix = matrix * weights
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    axes = _axes(matrix, min(rank, max(1, len(sample) - 1)))
    vectors = matrix @ axes
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    prior = counts.get(1, 0) / sum(counts.values())
    return NeighbourVote(weights, axes, vectors, votes, prior)


def score_quality(df: DataFrame, model: NeighbourVote, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``df`` with the score of its texts, from 0 to 1."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [c for c in df.columns if c != score_col]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(score_col, T.DoubleType())])

    def score(batches):
        model = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            parts = [model.score(rows) for _, rows in feature_blocks(column)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(c)) for c in names] + [pa.array(scores, pa.float64())],
                schema.fieldNames())

    return df.mapInArrow(score, schema)
