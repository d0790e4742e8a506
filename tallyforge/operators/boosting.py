"""Boosted small trees over histograms, with the weights of the rows carried along.

Features are cut into at most ``BINS`` intervals once. What a tree needs to know of the rows is then one
table of sums by (node, feature, interval), added up inside the tasks; its size depends on the number of
features, not on the rows. A stump is one such pass, and the error of the round follows from the same
sums. Rows are stored as blocks, one byte string for each of codes, targets and weights, so a pass reads
few values and compares whole columns of bytes. Row weights: the rounds since the last reliable checkpoint
are applied when the blocks are read, and every ``CARRY`` rounds the weights are written anew, so plan and
work per round stay the same however many rounds there are. Fitted trees are arrays in heap order and are
applied to Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.persistence import StoredModel, array_table, arrays_of
from tallyforge.session import materialise

BINS = 32
UNSPLIT = 255  # no interval is above it
CARRY = 10
CELLS = 2 ** 21  # of the grid of all intervals, up to which a task adds up its rows by cell
GATHERED_CELLS = 2 ** 18  # up to which the cells come to the driver
SEED = 42


def cut_points(df: DataFrame, width: int) -> list[np.ndarray]:
    """Ascending candidate thresholds of every feature; the largest value is none."""
    shares = [i / BINS for i in range(1, BINS)]
    long = df.select(F.posexplode("x").alias("feature", "value")).groupBy("feature").agg(
        F.percentile_approx("value", shares, 10_000).alias("cuts"), F.max("value").alias("top"))
    found = {r["feature"]: sorted({c for c in r["cuts"] if c < r["top"]}) for r in long.collect()}  # one row a feature
    return [np.array(found.get(f, []), float) for f in range(width)]


def spark_thresholds(df: DataFrame, width: int, bins: int, rows: int, seed: int = SEED) -> list[np.ndarray]:
    """The candidate thresholds that Spark's trees take of every feature, from the same rows: all of them up to
    10,000 or ``bins`` squared, else a sample of about that many. Every row takes part in the trees."""
    spark, bins = df.sparkSession, min(bins, rows)
    wanted = max(bins * bins, 10_000)
    share = wanted / rows if wanted < rows else 1.0
    if share < 1.0:
        drawn = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
        taken = df.select("x")._jdf.toJavaRDD().sample(False, share, drawn)
        kind = spark.sparkContext._jvm.org.apache.spark.sql.types.DataType.fromJson(df.select("x").schema.json())
        df = DataFrame(spark._jsparkSession.createDataFrame(taken, kind), spark)

    def of(pdf: pd.DataFrame) -> pd.DataFrame:
        values, counts = np.unique(pdf["value"].to_numpy(), return_counts=True)
        counts, zeros = counts.astype(float), share * rows - len(pdf)
        if zeros > np.finfo(float).eps * len(pdf) * 100:
            at = int(np.searchsorted(values, 0.0))
            values, counts = np.insert(values, at, 0.0), np.insert(counts, at, zeros)
        middles = (values[:-1] + values[1:]) / 2.0
        if len(middles) >= bins:
            stride = target = share * rows / bins
            sums, taken = np.cumsum(counts).tolist(), []
            for i, (before, after) in enumerate(zip(sums[:-1], sums[1:])):
                if abs(before - target) < abs(after - target):
                    taken.append(i)
                    target += stride
            middles = middles[taken]
        return pd.DataFrame({"feature": [int(pdf["feature"].iloc[0])], "cuts": [middles.tolist()]})

    long = df.select(F.posexplode("x").alias("feature", "value")).filter("value <> 0.0")
    found = {r["feature"]: r["cuts"] for r in long.groupBy("feature").applyInPandas(of, "feature int, cuts array<double>").collect()}
    return [np.array(found.get(f, []), float) for f in range(width)]


def _codes(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, f], "left").astype(np.uint8) for f, c in enumerate(cuts)])


def _checked(x: np.ndarray) -> np.ndarray:
    if not np.isfinite(x).all():
        raise ValueError("features must not be NaN or infinite")
    return x


def coded(df: DataFrame, cuts: list[np.ndarray], check=lambda x: x) -> DataFrame:
    """``codes, y, w``: a block for each Arrow batch of rows, with the interval of every feature as a byte,
    feature after feature. ``df``: ``x, y, w``; ``check`` sees the features first."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = check(_matrix(batch.column(0), len(cuts)))
                yield _block(_codes(x, cuts), batch.column(1).to_numpy(), batch.column(2).to_numpy())

    return df.select("x", "y", "w").mapInArrow(run, BLOCK)


BLOCK = "codes binary, y binary, w binary"


def summed(df: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """``cell, y, w``: targets and weights of each task, added up by cell of the grid of intervals."""
    shape = [len(c) + 1 for c in cuts]
    cells = math.prod(shape)

    def run(batches):
        y, w, held, size = np.zeros(cells), np.zeros(cells), [], 0

        def add():
            at, own, weight = (np.concatenate(part) for part in zip(*held))
            y[:] += np.bincount(at, own * weight, cells)
            w[:] += np.bincount(at, weight, cells)

        for batch in batches:
            if batch.num_rows:
                x = _checked(_matrix(batch.column(0), len(cuts)))
                at = np.ravel_multi_index(tuple(_codes(x, cuts).astype(np.int64)), shape)
                held.append((at, batch.column(1).to_numpy(), batch.column(2).to_numpy()))
                size += batch.num_rows
            if size > cells:  # as many as a sum has to pass over
                add()
                held, size = [], 0
        if held:
            add()
        at = np.flatnonzero(w)
        for i in range(0, len(at), 100_000):
            part = at[i:i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(y[part]), pa.array(w[part])], ["cell", "y", "w"])

    return df.select("x", "y", "w").mapInArrow(run, "cell long, y double, w double")


def _unravelled(cells: np.ndarray, shape: list[int]) -> np.ndarray:
    return np.stack(np.unravel_index(cells, shape)).astype(np.uint8)


def celled(cells: DataFrame, shape: list[int]) -> DataFrame:
    """Blocks of cells."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                at, y, w = (batch.column(i).to_numpy() for i in range(3))
                yield _block(_unravelled(at, shape), y, w)

    return cells.mapInArrow(run, BLOCK)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _block(codes: np.ndarray, y: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary()) for part in (codes, y, w)], ["codes", "y", "w"])


def _blocks(batches):
    """Codes (a row a feature), targets and stored weights of every block."""
    for batch in batches:
        for codes, y, w in zip(*(batch.column(i) for i in range(3))):
            y, w = np.frombuffer(y.as_buffer(), float), np.frombuffer(w.as_buffer(), float)
            yield np.frombuffer(codes.as_buffer(), np.uint8).reshape(-1, len(y)), y, w


class _Tree:
    """A complete tree of a fixed depth in heap order, over the intervals of the features.

    A node that is not split sends all rows left (its cut is ``UNSPLIT``)."""

    def __init__(self, depth: int):
        self.depth = depth
        self.feature = np.zeros(2 ** depth - 1, np.int64)
        self.cut = np.full(2 ** depth - 1, UNSPLIT, np.int64)
        self.gain = np.zeros(2 ** depth - 1)
        self.value = np.zeros(2 ** depth)

    def node(self, codes: np.ndarray, levels: int) -> np.ndarray:
        """Place of every row in its level after that many splits."""
        at = np.zeros(codes.shape[1], np.min_scalar_type(2 ** self.depth))
        for level in range(levels):
            right = np.zeros(len(at), bool)
            for place in range(2 ** level):
                here = place + 2 ** level - 1
                right |= (at == place) & (codes[self.feature[here]] > int(self.cut[here]))
            at = 2 * at + right
        return at

    def predict(self, codes: np.ndarray) -> np.ndarray:
        return self.value[self.node(codes, self.depth)]


def _add_sums(total: np.ndarray, codes: np.ndarray, node: np.ndarray, wanted) -> None:
    """Adds the parts of a block to (nodes, features, intervals, parts)."""
    nodes, width, bins, parts = total.shape
    node = node * np.intp(bins)
    for f in range(width):
        place = node + codes[f]
        for part, weight in wanted:
            if np.ndim(part):
                total[:, f] += np.bincount(place * parts + part, weight, nodes * bins * parts).reshape(nodes, bins, parts)
            else:
                total[:, f, :, part] += np.bincount(place, weight, nodes * bins).reshape(nodes, bins)


class _Rows:
    """Blocks of coded rows with the weights of the last checkpoint and the rounds since then."""

    def __init__(self, df: DataFrame, width: int, bins: int = BINS):
        self.df, self.width, self.bins = materialise(df), width, bins
        self.pending: list = []
        self.total = 1.0

    def state(self):
        """A function from codes, targets and stored weights to present targets and weights."""
        pending = list(self.pending)

        def now(codes, y, w):
            for update in pending:
                w = w * update(codes, y)
            return y, w

        return now

    def add(self, update, total: float) -> None:
        self.pending.append(update)
        self.total = total

    def _store(self) -> None:
        now, total = self.state(), self.total

        def run(batches):
            for codes, y, w in _blocks(batches):
                y, w = now(codes, y, w)
                yield _block(codes, y, w / total)

        self.df = materialise(self.df.mapInArrow(run, BLOCK))
        self.pending = []

    def sums(self, tree: _Tree, level: int, of, parts: int) -> np.ndarray:
        """(nodes of a level, features, intervals, parts) of weighted sums; ``of(y, w)`` gives the
        parts of every row as (place, weight) pairs, the place a number or an array."""
        if len(self.pending) >= CARRY:
            self._store()
        now, width, bins, nodes = self.state(), self.width, self.bins, 2 ** level

        def run(batches):
            total = np.zeros((nodes, width, bins, parts))
            for codes, y, w in _blocks(batches):
                _add_sums(total, codes, tree.node(codes, level), of(*now(codes, y, w)))
            flat = total.reshape(nodes * width, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(flat)), pa.int32()), pa.array(list(flat), pa.list_(pa.float64()))], ["place", "part"])

        def add(batches):
            merged: dict[int, np.ndarray] = {}
            for batch in batches:
                for place, part in zip(batch.column(0).to_pylist(), _matrix(batch.column(1), bins * parts)):
                    merged[place] = merged.get(place, 0.0) + part
            yield pa.RecordBatch.from_arrays([pa.array(list(merged), pa.int32()), pa.array(list(merged.values()), pa.list_(pa.float64()))], ["place", "part"])

        schema = "place int, part array<double>"
        out = np.zeros((nodes * width, bins * parts))
        merged = self.df.mapInArrow(run, schema).repartition("place").mapInArrow(add, schema)
        for r in merged.collect():  # one row for each node and feature
            out[r["place"]] = r["part"]
        return out.reshape(nodes, width, bins, parts)


class _Sums(_Rows):
    """Blocks of cells: sums of targets, which every round lowers by what it predicts, and of weights."""

    def state(self):
        pending = list(self.pending)

        def now(codes, y, w):
            for update in pending:
                y = y - w * update(codes)
            return y, w

        return now

    def lower(self, update) -> None:
        self.add(update, 1.0)


class _Gathered:
    """All cells of a small grid on the driver."""

    def __init__(self, cells: DataFrame, shape: list[int]):
        found = cells.groupBy("cell").agg(F.sum("y").alias("y"), F.sum("w").alias("w")).toArrow()  # GATHERED_CELLS rows at most
        at, self.y, self.w = (found.column(i).to_numpy() for i in range(3))
        self.codes, self.bins = _unravelled(at, shape), max(shape)

    def lower(self, update) -> None:
        self.y = self.y - self.w * update(self.codes)

    def sums(self, tree: _Tree, level: int, of, parts: int) -> np.ndarray:
        total = np.zeros((2 ** level, len(self.codes), self.bins, parts))
        _add_sums(total, self.codes, tree.node(self.codes, level), of(self.y, self.w))
        return total


def _sides(sums: np.ndarray):
    """Sums left and right of every cut of one node."""
    below = np.cumsum(sums, axis=1)
    return below[:, :-1], below[:, -1:] - below[:, :-1]


def _split_level(tree: _Tree, level: int, sums: np.ndarray, means: np.ndarray, least: float) -> np.ndarray:
    """Splits the nodes of a level where the square error falls most, by more than a share of ``least`` of what
    the mean explains; the means of the nodes below. Parts of ``sums``: weights, weighted targets."""
    def purity(side):
        return np.divide(side[..., 1] ** 2, side[..., 0], out=np.zeros(side.shape[:-1]), where=side[..., 0] > 0)

    below = np.zeros(2 ** (level + 1))
    for node in range(2 ** level):
        left, right = _sides(sums[node])
        whole = sums[node][0].sum(axis=0)
        mean = whole[1] / whole[0] if whole[0] > 0 else means[node]
        valid = (left[..., 0] > 0) & (right[..., 0] > 0)
        gain = np.where(valid, purity(left) + purity(right) - purity(whole), -np.inf)
        best = int(np.argmax(gain))
        below[2 * node:2 * node + 2] = mean
        if gain.flat[best] > least * max(abs(float(purity(whole))), 1e-300):
            f, c = divmod(best, gain.shape[1])
            here = 2 ** level - 1 + node
            tree.feature[here], tree.cut[here], tree.gain[here] = f, c, gain.flat[best]
            below[2 * node] = left[f, c, 1] / left[f, c, 0]
            below[2 * node + 1] = right[f, c, 1] / right[f, c, 0]
    return below


class AdaBoost(Estimator):
    """Boosted stumps for classes (SAMME)."""

    def __init__(self, rounds: int = 50, rate: float = 1.0, classes: int = 2):
        super().__init__()
        self.rounds, self.rate, self.classes = rounds, rate, classes
        self.errors: list[float] = []

    def _fit(self, df: DataFrame) -> "AdaBoostModel":
        weight = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
        base = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"), weight.alias("w")).persist()
        width, classes = len(base.select("x").first().x), self.classes
        cuts = cut_points(base, width)
        rows = _Rows(coded(base, cuts), width)
        base.unpersist()
        self.errors, stumps, alphas = [], [], []

        def purity(side):  # weight less its Gini impurity
            total = side.sum(axis=-1)
            return np.divide((side * side).sum(axis=-1), total, out=np.zeros_like(total), where=total > 0)

        for _ in range(self.rounds):
            stump = _Tree(1)
            sums = rows.sums(stump, 0, lambda y, w: [(y.astype(np.int64), w)], classes)[0]
            left, right = _sides(sums)
            whole = sums[0].sum(axis=0)
            total = float(whole.sum())
            valid = (left.sum(axis=2) > 0) & (right.sum(axis=2) > 0)
            gain = np.where(valid, purity(left) + purity(right), -np.inf)
            best = int(np.argmax(gain))
            if np.isfinite(gain.flat[best]):
                f, c = divmod(best, gain.shape[1])
                stump.feature[0], stump.cut[0], stump.gain[0] = f, c, 1.0
                halves = left[f, c], right[f, c]
            else:  # nothing to split
                halves = whole, whole * 0
            stump.value[:] = [int(np.argmax(h)) if h.any() else int(np.argmax(whole)) for h in halves]
            error = max(0.0, 1.0 - sum(float(h.max()) for h in halves) / total)
            self.errors.append(error)
            if error >= 1.0 - 1.0 / classes:
                break
            stumps.append(stump)
            if error <= 1e-15:
                alphas.append(1.0)
                break
            alpha = self.rate * (math.log((1.0 - error) / error) + math.log(classes - 1.0))
            alphas.append(alpha)
            rows.add(lambda codes, y, s=stump, a=alpha: np.exp(a * (s.predict(codes) != y)), total)
        if not stumps:
            stumps, alphas = [stump], [1.0]
        return AdaBoostModel(TreeTable.of(stumps, alphas, cuts), classes, width)


class AdaBoostRegressor(Estimator):
    """AdaBoost.R2 with small trees; weights take the place of resampling."""

    def __init__(self, rounds: int = 50, rate: float = 1.0, depth: int = 3):
        super().__init__()
        self.rounds, self.rate, self.depth = rounds, rate, depth

    def _fit(self, df: DataFrame) -> "AdaBoostRegressorModel":
        base = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"), F.lit(1.0).alias("w")).persist()
        width = len(base.select("x").first().x)
        cuts = cut_points(base, width)
        rows = _Rows(coded(base, cuts), width)
        base.unpersist()
        trees, alphas = [], []
        for _ in range(self.rounds):
            tree = self._grow(rows)
            top, total, gap = self._loss(rows, tree)
            if not top:
                trees.append(tree)
                alphas.append(1.0)
                break
            loss = gap / (total * top)
            if loss >= 0.5:
                break
            beta = loss / (1.0 - loss)
            trees.append(tree)
            alphas.append(self.rate * math.log(1.0 / beta))
            step = self.rate * math.log(beta)
            rows.add(lambda codes, y, t=tree, s=step, m=top: np.exp(s * (1.0 - np.abs(t.predict(codes) - y) / m)), total)
        if not trees:
            trees, alphas = [tree], [1.0]
        return AdaBoostRegressorModel(TreeTable.of(trees, alphas, cuts), width)

    def _grow(self, rows: _Rows) -> _Tree:
        """One tree, a pass a level: the split that lowers the weighted square error most."""
        tree = _Tree(self.depth)

        def parts(y, w):
            return [(0, w), (1, w * y)]

        means = np.zeros(1)
        for level in range(self.depth):
            means = _split_level(tree, level, rows.sums(tree, level, parts, 2), means, 1e-12)
        tree.value = means
        return tree

    @staticmethod
    def _loss(rows: _Rows, tree: _Tree) -> tuple[float, float, float]:
        """Largest absolute error, sum of weights, weighted sum of absolute errors."""
        now = rows.state()

        def run(batches):
            for codes, y, w in _blocks(batches):
                (y, w), gap = now(codes, y, w), np.abs(tree.predict(codes) - y)
                yield pa.RecordBatch.from_arrays([pa.array([gap.max()]), pa.array([w.sum()]), pa.array([(w * gap).sum()])], ["top", "w", "g"])

        found = rows.df.mapInArrow(run, "top double, w double, g double").agg(F.max("top"), F.sum("w"), F.sum("g")).first()
        return float(found[0] or 0.0), float(found[1] or 0.0), float(found[2] or 0.0)


class GradientBoosting(Estimator):
    """Gradient-boosted trees for the square loss: the trees of Spark's ``GBTRegressor``, over sums.

    All rows of a cell of the grid of intervals are predicted alike, so a tree needs of them only their
    number and the sum of their labels. Where the grid is small, each task adds up its rows by cell, and the
    cells of a smaller one come to the driver: rows are then passed over once, however many rounds there are.
    A larger grid (many features, or many intervals of several) leaves its rows in blocks, and each level of
    a tree is a pass over these.
    """

    def __init__(self, rounds: int = 20, rate: float = 0.1, depth: int = 3, bins: int = BINS):
        super().__init__()
        self.rounds, self.rate, self.depth, self.bins = rounds, rate, depth, bins

    def _fit(self, df: DataFrame) -> "GradientBoostingModel":
        y = F.col("label").cast("double")
        y = F.when(y.isNull() | F.isnan(y) | (F.abs(y) == float("inf")), F.raise_error(F.lit("labels must not be null, NaN or infinite"))).otherwise(y)
        base = df.select(vector_to_array("features").alias("x"), y.alias("y"), F.lit(1.0).alias("w"))
        width = len(base.select("x").first().x)
        cuts = spark_thresholds(base, width, self.bins, base.count())
        trees, rows = [], self._rows(base, cuts)
        for i in range(self.rounds):
            tree = _Tree(self.depth)
            means = np.zeros(1)
            for level in range(self.depth):
                means = _split_level(tree, level, rows.sums(tree, level, lambda y, w: [(0, w), (1, y)], 2), means, 0.0)
            tree.value = means if not i else 2.0 * means  # the loss falls by twice the residual
            tree.gain *= 1.0 if not i else 4.0
            trees.append(tree)
            rows.lower(lambda codes, t=tree, s=self.rate if i else 1.0: s * t.predict(codes))
        return GradientBoostingModel(TreeTable.of(trees, [self.rate if i else 1.0 for i in range(len(trees))], cuts), width)

    @staticmethod
    def _rows(base: DataFrame, cuts: list[np.ndarray]) -> "_Sums | _Gathered":
        shape = [len(c) + 1 for c in cuts]
        cells = math.prod(shape)
        if cells <= GATHERED_CELLS:
            return _Gathered(summed(base, cuts), shape)
        blocks = celled(summed(base, cuts), shape) if cells <= CELLS else coded(base, cuts, _checked)
        return _Sums(blocks, len(cuts), max(shape))


class TreeTable:
    """Trees of one depth as arrays: features, thresholds and gains of inner nodes, values of leaves."""

    def __init__(self, feature, threshold, gain, value, alpha):
        self.feature, self.threshold, self.gain, self.value, self.alpha = feature.astype(np.int64), threshold, gain, value, alpha
        self.depth = int(self.value.shape[1]).bit_length() - 1

    @classmethod
    def of(cls, trees: list[_Tree], alphas: list[float], cuts: list[np.ndarray]) -> "TreeTable":
        def threshold(f, c):
            return cuts[f][c] if c < len(cuts[f]) else np.inf

        return cls(np.array([t.feature for t in trees]),
                   np.array([[threshold(f, c) for f, c in zip(t.feature, t.cut)] for t in trees]),
                   np.array([t.gain for t in trees]), np.array([t.value for t in trees]), np.array(alphas))

    def predictions(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees)"""
        out, rows = np.empty((len(x), len(self.alpha))), np.arange(len(x))
        for t in range(len(self.alpha)):
            at = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                here = at + 2 ** level - 1
                at = 2 * at + ~(x[rows, self.feature[t, here]] <= self.threshold[t, here])
            out[:, t] = self.value[t, at]
        return out

    def total(self):
        """A function from rows to the weighted sum of the trees: features are coded once by the thresholds
        that occur, then compared as bytes."""
        finite = np.isfinite(self.threshold)
        cuts = [np.unique(self.threshold[finite & (self.feature == f)]) for f in range(int(self.feature.max()) + 1)]
        trees = []
        for feature, threshold, value, alpha in zip(self.feature, self.threshold, self.value, self.alpha):
            tree = _Tree(self.depth)
            tree.feature, tree.value = feature, value * alpha
            tree.cut[:] = [np.searchsorted(cuts[f], t) if np.isfinite(t) else UNSPLIT for f, t in zip(feature, threshold)]
            trees.append(tree)

        def of(x: np.ndarray) -> np.ndarray:
            out = np.zeros(len(x))
            for i in range(0, len(x), 10_000):
                codes = _codes(x[i:i + 10_000], cuts)
                for tree in trees:
                    out[i:i + 10_000] += tree.predict(codes)
            return out

        return of

    def importances(self, width: int) -> np.ndarray:
        """Share of every feature in the gains of each tree, averaged by the trees' weights."""
        out = np.zeros(width)
        for t, alpha in enumerate(self.alpha):
            total = self.gain[t].sum()
            if total > 0:
                np.add.at(out, self.feature[t], alpha * self.gain[t] / total)
        return out / self.alpha.sum()

    def table(self, spark):
        return array_table(spark, feature=self.feature, threshold=self.threshold, gain=self.gain, value=self.value, alpha=self.alpha)


class AdaBoostModel(StoredModel):
    def __init__(self, trees: TreeTable, classes: int, width: int):
        super().__init__()
        self.trees, self.classes, self.width = trees, classes, width

    def _transform(self, df: DataFrame) -> DataFrame:
        trees, classes = self.trees, self.classes

        @F.pandas_udf("prediction double, probability array<double>")
        def vote(xs: pd.Series) -> pd.DataFrame:
            if not len(xs):
                return pd.DataFrame({"prediction": [], "probability": []})
            said = trees.predictions(np.vstack(xs.to_numpy()))
            share = np.stack([(said == c) @ trees.alpha for c in range(classes)], axis=1) / trees.alpha.sum()
            raw = (share * classes - 1.0) / max(1, classes - 1) ** 2
            parts = np.exp(raw - raw.max(axis=1, keepdims=True))
            return pd.DataFrame({"prediction": share.argmax(axis=1).astype(float),
                                 "probability": list(parts / parts.sum(axis=1, keepdims=True))})

        found = df.withColumn("_vote", vote(vector_to_array("features")))
        return found.withColumns({"prediction": F.col("_vote.prediction"),
                                  "probability": array_to_vector(F.col("_vote.probability"))}).drop("_vote")

    @property
    def importances(self) -> np.ndarray:
        return self.trees.importances(self.width)

    def contents(self, spark):
        return {"classes": self.classes, "width": self.width}, {"trees": self.trees.table(spark)}, {}

    @classmethod
    def restored(cls, facts, tables, models):
        return cls(TreeTable(**arrays_of(tables["trees"])), facts["classes"], facts["width"])


class AdaBoostRegressorModel(StoredModel):
    def __init__(self, trees: TreeTable, width: int):
        super().__init__()
        self.trees, self.width = trees, width

    def _transform(self, df: DataFrame) -> DataFrame:
        """Weighted median of the trees: the first prediction that reaches half of the weight."""
        trees = self.trees

        @F.pandas_udf("double")
        def median(xs: pd.Series) -> pd.Series:
            if not len(xs):
                return pd.Series([], dtype=float)
            said = trees.predictions(np.vstack(xs.to_numpy()))
            order = np.argsort(said, axis=1, kind="stable")
            reached = np.cumsum(trees.alpha[order], axis=1) >= trees.alpha.sum() / 2.0
            return pd.Series(np.take_along_axis(said, order, axis=1)[np.arange(len(said)), reached.argmax(axis=1)])

        return df.withColumn("prediction", median(vector_to_array("features")))

    @property
    def importances(self) -> np.ndarray:
        return self.trees.importances(self.width)

    def contents(self, spark):
        return {"width": self.width}, {"trees": self.trees.table(spark)}, {}

    @classmethod
    def restored(cls, facts, tables, models):
        return cls(TreeTable(**arrays_of(tables["trees"])), facts["width"])


class GradientBoostingModel(StoredModel):
    def __init__(self, trees: TreeTable, width: int):
        super().__init__()
        self.trees, self.width = trees, width

    def _transform(self, df: DataFrame) -> DataFrame:
        total, width = self.trees.total(), self.width

        @F.arrow_udf("double")
        def predicted(x: pa.Array) -> pa.Array:
            return pa.array(total(_matrix(x, width)) if len(x) else [], pa.float64())

        return df.withColumn("prediction", predicted(vector_to_array("features")))

    @property
    def importances(self) -> np.ndarray:
        """Share of every feature in the gains of all trees."""
        out = np.zeros(self.width)
        np.add.at(out, self.trees.feature, self.trees.gain)
        return out / out.sum() if out.sum() > 0 else out

    def contents(self, spark):
        return {"width": self.width}, {"trees": self.trees.table(spark)}, {}

    @classmethod
    def restored(cls, facts, tables, models):
        return cls(TreeTable(**arrays_of(tables["trees"])), facts["width"])
