"""Regression with an epsilon-insensitive loss: residuals inside a tube cost nothing.

The objective is ``|w|^2 / (2 C n) + mean(max(0, |y - f(x)| - epsilon))`` with a free intercept. Its
kink is rounded over a width ``mu`` that shrinks step by step, and each rounded objective is minimised
by Newton's method. A round is one pass over the rows: every task adds up loss, gradient and the
products of the rows on the rounded part, for this width and for the next ones, so that shrinking needs no
pass of its own. Spark sums them by matrix row, and the driver receives (width + 3) rows of (width + 1)
numbers for each of ``AHEAD`` widths whatever the input. Rows are kept as blocks of bytes, one for each Arrow
batch, and lifted a few at a time. Rounding changes the mean loss by at most
``mu / 2``; with the fall that Newton's step still promises this gives the objective's distance from its
optimum (``gap``). Rounds end when it is at most ``precision`` times the spread of the labels, whatever
their unit, or after ``ROUNDS``.

Defined results: rows without a label or with one that is not a number are left out; equal labels give
the constant; a table without rows is refused.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.persistence import StoredModel, array_table, arrays_of

PRECISION = 1e-3
ROUNDS = 100
# Widths of the rounded part that a pass sums up for, each a quarter of the one before; rows lifted at once.
AHEAD = 3
ROWS_AT_ONCE = 512


def _packed(rows: DataFrame) -> DataFrame:
    """A block for each Arrow batch: the bytes of ``x`` (row after row) and ``y``, numbers in a row, and the
    count, mean and squares around it of ``y``."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                y = batch.column(1).to_numpy(zero_copy_only=False)
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
                mean = float(y.mean())
                yield pa.RecordBatch.from_pydict({"x": [x.tobytes()], "y": [y.tobytes()], "d": pa.array([x.shape[1]], pa.int32()),
                                                  "n": [len(y)], "mean": [mean], "square": [float(((y - mean) ** 2).sum())]})

    return rows.mapInArrow(run, "x binary, y binary, d int, n long, mean double, square double")


def _blocks(batches):
    for batch in batches:
        for x, y in zip(batch.column(0), batch.column(1)):
            y = np.frombuffer(y.as_buffer(), float)
            yield np.frombuffer(x.as_buffer(), float).reshape(len(y), -1), y


class TubeRegression(Estimator):
    """Linear machine with the epsilon tube. ``lift`` maps a block of rows to their features inside the
    tasks, so lifted rows are never moved or stored."""

    def __init__(self, c: float = 1.0, epsilon: float = 0.1, lift=None, featuresCol: str = "features",
                 precision: float = PRECISION):
        super().__init__()
        self.c, self.epsilon, self.lift, self.features, self.precision = c, epsilon, lift, featuresCol, precision

    def totals(self, blocks: DataFrame, at: np.ndarray, mu: float) -> list[tuple[np.ndarray, np.ndarray, float, float]]:
        """Sums over all rows at the coefficients ``at`` (intercept last), for ``mu`` and the widths after
        it: products of the rows on the rounded part, gradient, rounded loss, loss."""
        lift, epsilon, size = self.lift, self.epsilon, len(at)
        widths = [mu / 4 ** i for i in range(AHEAD)]

        def add(batches):
            total = np.zeros((AHEAD, size + 2, size))
            for xs, ys in _blocks(batches):
                for i in range(0, len(ys), ROWS_AT_ONCE):  # the lifted rows stay in the processor's cache
                    x, y = xs[i:i + ROWS_AT_ONCE], ys[i:i + ROWS_AT_ONCE]
                    x = np.hstack([lift(x) if lift else x, np.ones((len(y), 1))])
                    rest = y - x @ at
                    over = np.abs(rest) - epsilon
                    outside, side = np.maximum(over, 0.0), np.sign(rest)
                    slopes = np.stack([side * np.minimum(outside / mu, 1.0) for mu in widths]) @ x
                    for sums, slope, mu, narrower in zip(total, slopes, widths, [*widths[1:], 0.0]):
                        # only the rows that the next width leaves out: the driver adds up
                        bent = x[(over > 0) & (over >= narrower) & (over < mu)]
                        sums[:size] += bent.T @ bent
                        sums[size] -= slope
                        sums[size + 1, 0] += np.where(over < mu, outside ** 2 / (2 * mu), over - mu / 2).sum()
                        sums[size + 1, 1] += outside.sum()
            flat = total.reshape(-1, size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(flat)), pa.int32()), pa.array(list(flat), pa.list_(pa.float64()))], ["place", "numbers"])

        parts = blocks.select("x", "y").mapInArrow(add, "place int, numbers array<double>")
        sums = parts.groupBy("place").agg(Summarizer.sum(array_to_vector("numbers")).alias("numbers"))
        total = np.array([r.numbers.toArray() for r in sorted(sums.collect(), key=lambda r: r.place)])  # AHEAD times width + 3 rows
        total = total.reshape(AHEAD, size + 2, size)
        return [(total[i:, :size].sum(axis=0), t[size], t[size + 1, 0], t[size + 1, 1]) for i, t in enumerate(total)]

    def _fit(self, df: DataFrame) -> "TubeModel":
        label = F.col("label").cast("double")
        rows = df.filter(label.isNotNull() & ~F.isnan(label)).select(vector_to_array(self.features).alias("x"), label.alias("y"))
        rows = _packed(rows).persist()
        facts = rows.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("total"), F.max("d").alias("d")).first()
        if not facts.n:
            raise ValueError("no rows with a label")
        n, width, mean = facts.n, facts.d, facts.total / facts.n
        away = F.col("mean") - F.lit(mean)
        spread = float(np.sqrt(rows.agg(F.sum(F.col("square") + F.col("n") * away * away).alias("s")).first().s / n))
        if self.lift:
            width = self.lift(np.zeros((1, width))).shape[1]
        at, gap = np.append(np.zeros(width), mean), 0.0
        if spread > 1e-12 * max(1.0, abs(mean)):
            at, gap = self._minimise(rows, at, n, spread)
        rows.unpersist()
        return TubeModel(at[:-1], float(at[-1]), gap, self.features)

    def _minimise(self, rows: DataFrame, at: np.ndarray, n: int, spread: float) -> tuple[np.ndarray, float]:
        shrink = np.append(np.full(len(at) - 1, 1.0 / (self.c * n)), 0.0)  # the intercept is free

        def states(at, mu):
            """The objective at this width and the next ones: rounded, plain, gradient, curvature."""
            out, weight = [], (shrink * at * at).sum() / 2
            for i, (products, slope, smooth, loss) in enumerate(self.totals(rows, at, mu)):
                bend = products / (n * mu / 4 ** i) + np.diag(shrink + 1e-9 / (mu / 4 ** i))
                out.append((smooth / n + weight, loss / n + weight, slope / n + shrink * at, bend))
            return out

        mu, goal = 2.0 * spread, self.precision * spread
        (value, whole, slope, bend), *ahead = states(at, mu)
        for _ in range(ROUNDS):
            move = np.linalg.solve(bend, -slope)
            falls = -(slope @ move)
            if falls <= 0.1 * mu * self.precision or falls <= 0.02 * mu * (mu > goal):
                if whole - value + falls <= goal:
                    break
                mu /= 4
                (value, whole, slope, bend), *ahead = ahead or states(at, mu)
                continue
            step = 1.0
            while True:
                found = states(at + step * move, mu)
                if found[0][0] <= value - 1e-4 * step * falls or step < 1e-6:
                    break
                step /= 4
            if step < 1e-6:
                break
            at = at + step * move
            (value, whole, slope, bend), *ahead = found
        return at, float(whole - value + max(falls, 0.0))


class TubeModel(StoredModel):
    """``gap``: how far the mean objective may stand above its optimum."""

    def __init__(self, weights: np.ndarray, intercept: float, gap: float, features: str):
        super().__init__()
        self.weights, self.intercept, self.gap, self.features = weights, intercept, gap, features

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.predicted(df, self.features)

    def predicted(self, df: DataFrame, features: str, lift=None) -> DataFrame:
        weights, intercept = self.weights, self.intercept

        @F.pandas_udf("double")
        def predict(xs: pd.Series) -> pd.Series:
            if not len(xs):
                return pd.Series([], dtype=float)
            x = np.vstack(xs.to_numpy())
            parts = (x[i:i + ROWS_AT_ONCE] for i in range(0, len(x), ROWS_AT_ONCE))
            return pd.Series(np.concatenate([(lift(part) if lift else part) @ weights for part in parts]) + intercept)

        return df.withColumn("prediction", predict(vector_to_array(features)))

    def contents(self, spark):
        return {"features": self.features}, {"weights": array_table(spark, weights=self.weights, rest=np.array([self.intercept, self.gap]))}, {}

    @classmethod
    def restored(cls, facts, tables, models):
        found = arrays_of(tables["weights"])
        return cls(found["weights"], float(found["rest"][0]), float(found["rest"][1]), facts["features"])
