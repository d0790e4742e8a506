"""The epsilon-insensitive regression against an independent solver of its dual."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tallyforge.operators import learners
from tallyforge.operators.tube import PRECISION, TubeRegression


def table(spark, x, y, parts=3):
    rows = [(i, [float(v) for v in a], None if b is None else float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "key long, x array<double>, label double").repartition(parts, "key")
    return df.select("key", array_to_vector("x").alias("features"), "label")


def objective(x, y, weights, intercept, c, epsilon):
    over = np.maximum(np.abs(y - x @ weights - intercept) - epsilon, 0)
    return weights @ weights / (2 * c * len(y)) + over.mean()


def optimum(x, y, c, epsilon, rounds=60_000):
    """Value of the dual by pairwise ascent: moves along a_i + a_j = const, so every value is a lower bound."""
    n, kernel = len(y), x @ x.T
    a, margin, rng = np.zeros(n), np.zeros(n), np.random.default_rng(0)
    for _ in range(rounds):
        i, j = rng.choice(n, 2, replace=False)
        curve = kernel[i, i] + kernel[j, j] - 2 * kernel[i, j]
        low, high = max(-c - a[i], a[j] - c), min(c - a[i], a[j] + c)
        base = (y[i] - margin[i]) - (y[j] - margin[j])
        steps = {low, high, -a[i], a[j]}
        if curve > 1e-12:
            steps |= {(base - epsilon * (s - t)) / curve for s in (-1, 1) for t in (-1, 1)}
        steps = np.clip(np.array(sorted(steps)), low, high)
        gain = base * steps - curve * steps ** 2 / 2 - epsilon * (
            np.abs(a[i] + steps) - abs(a[i]) + np.abs(a[j] - steps) - abs(a[j]))
        step = steps[gain.argmax()]
        a[i] += step
        a[j] -= step
        margin += step * (kernel[i] - kernel[j])
    return (a @ y - epsilon * np.abs(a).sum() - a @ kernel @ a / 2) / (c * n)


@pytest.mark.parametrize("c,epsilon,scale", [(1.0, 0.0, 1.0), (10.0, 0.5, 1.0), (0.05, 0.1, 1000.0)])
def test_the_optimum_is_met_within_the_stated_gap(spark, c, epsilon, scale):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 4))
    y = scale * (x @ [1.0, -2.0, 0.0, 0.5] + 3 + 0.3 * rng.standard_t(2, size=40))
    model = TubeRegression(c, epsilon).fit(table(spark, x, y))
    got, best = objective(x, y, model.weights, model.intercept, c, epsilon), optimum(x, y, c, epsilon)
    assert 0 <= model.gap <= PRECISION * y.std()
    assert best - 1e-9 * scale <= got <= best + model.gap + 1e-4 * y.std()


def test_far_labels_do_not_pull(spark):
    x = np.linspace(-1, 1, 101)[:, None]
    y = 2 * x[:, 0] + 1
    y[::10] += 500
    model = TubeRegression(100.0, 0.1).fit(table(spark, x, y))
    calm = np.ones(101, bool)
    calm[::10] = False
    assert np.abs(y - x @ model.weights - model.intercept)[calm].max() < 0.3


def test_partitions_do_not_matter(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=60)
    one, many = (TubeRegression(precision=0.05).fit(table(spark, x, y, p)) for p in (1, 7))
    assert np.allclose(one.weights, many.weights, atol=1e-6) and abs(one.intercept - many.intercept) < 1e-6


def test_odd_tables(spark):
    constant = TubeRegression(precision=0.05).fit(table(spark, [[1.0], [2.0], [3.0]], [5.0, 5.0, 5.0]))
    assert constant.intercept == 5.0 and not constant.weights.any()
    gaps = TubeRegression(precision=0.05).fit(table(spark, [[0.0], [1.0], [9.0], [9.0]], [0.0, 1.0, None, float("nan")]))
    plain = TubeRegression(precision=0.05).fit(table(spark, [[0.0], [1.0]], [0.0, 1.0]))
    assert np.allclose(gaps.weights, plain.weights) and np.isfinite(gaps.intercept)
    same = TubeRegression(precision=0.05).fit(table(spark, [[1.0]] * 6, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]))
    assert np.isfinite(same.intercept) and 2.9 <= same.intercept + same.weights[0] <= 4.1
    with pytest.raises(ValueError):
        TubeRegression(precision=0.05).fit(table(spark, [[1.0]], [None]))


def test_kernel_regression_bends(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-3, 3, size=(400, 1))
    df = table(spark, x, np.sin(2 * x[:, 0]) + 0.05 * rng.normal(size=400))
    out = learners.build("svm", "regression", 400, C=10.0, gamma=1.0).fit(df).transform(df)
    assert "_lifted" not in out.columns
    assert out.agg(F.avg(F.abs(F.col("label") - F.col("prediction"))).alias("e")).first().e < 0.12


def test_no_pass_repeats_coefficients(spark, monkeypatch):
    """Shrinking the rounded part reads the sums of the pass before it."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    y = x @ [2.0, -1.0] + rng.normal(size=300)
    seen, totals = [], TubeRegression.totals
    monkeypatch.setattr(TubeRegression, "totals", lambda self, rows, at, mu: seen.append(at.tobytes()) or totals(self, rows, at, mu))
    model = TubeRegression(precision=0.05).fit(table(spark, x, y))
    assert model.gap <= 0.05 * y.std() and len(seen) == len(set(seen))


def test_cosines_and_lifted_predictions(spark):
    """The polynomial is the cosine, and rows are lifted inside the prediction, never as a column."""
    from tallyforge.operators import learners

    turns = np.concatenate([np.linspace(-30, 30, 4001), [0.0, 0.25, 0.5, np.inf, np.nan]])
    with np.errstate(invalid="ignore"):
        np.testing.assert_allclose(learners.cosines(turns), np.cos(2 * np.pi * turns), atol=2e-13)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 3))
    df = table(spark, x, np.sin(x[:, 0]))
    model = learners.KernelMachine("regression").fit(df)
    out = model.transform(df)
    assert "_lifted" not in out._jdf.queryExecution().optimizedPlan().toString()
    lifted = model.model.transform(model.lift.transform(df, "_lifted")).select("prediction").collect()
    np.testing.assert_allclose([r.prediction for r in out.select("prediction").collect()], [r.prediction for r in lifted], rtol=1e-9)
