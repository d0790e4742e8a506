import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tallyforge.operators import clustering, isolation, learners
from tallyforge.plans import flows, tuning


@pytest.mark.parametrize("name", ["logistic", "decision_tree", "random_forest", "gradient_boosting", "adaboost",
                                  "gaussian_nb", "svm", "knn"])
def test_classifier_beats_the_majority(signal, name):
    train, test = signal
    model = learners.build(name, "classification", 400, n_estimators=10, max_depth=5).fit(train)
    out = model.transform(test)
    found = tuning.evaluate(out, "classification")
    assert found["accuracy"] > 0.75 and found["roc_auc"] > 0.85
    p = out.select(vector_to_array("probability").alias("p")).collect()
    assert all(0 <= v <= 1 for r in p for v in r.p) and all(abs(sum(r.p) - 1) < 1e-9 for r in p)
    if name not in ("logistic", "random_forest"):
        return
    again = learners.build(name, "classification", 400, n_estimators=10, max_depth=5).fit(train).transform(test)
    assert sorted(r.prediction for r in out.select("prediction").collect()) == sorted(
        r.prediction for r in again.select("prediction").collect())


@pytest.mark.parametrize("name", ["linear", "decision_tree", "random_forest", "gradient_boosting", "adaboost", "svm", "knn"])
def test_regressor_beats_the_mean(signal, name):
    train, test = (df.drop("label").withColumnRenamed("value", "label") for df in signal)
    model = learners.build(name, "regression", 400, n_estimators=10, max_depth=5).fit(train)
    assert tuning.evaluate(model.transform(test), "regression")["r2"] > 0.5


def test_boosting_error_falls(signal):
    train, test = signal
    few = tuning.evaluate(learners.AdaBoost(1).fit(train).transform(train), "classification")["accuracy"]
    many = tuning.evaluate(learners.AdaBoost(5).fit(train).transform(train), "classification")["accuracy"]
    assert many > few


def test_three_classes(blobs):
    df = blobs.withColumn("label", F.col("truth").cast("double"))
    for name in ("adaboost", "gaussian_nb", "svm", "logistic"):
        model = learners.build(name, "classification", 150, classes=3, n_estimators=3).fit(df)
        assert tuning.evaluate(model.transform(df), "classification", 3)["accuracy"] > 0.95, name


def _same_partition(labelled):
    groups = labelled.groupBy("truth").agg(F.countDistinct("cluster").alias("k"), F.min("cluster").alias("c")).collect()
    return all(r.k == 1 for r in groups) and len({r.c for r in groups}) == 3


@pytest.mark.parametrize("name,params", [
    ("kmeans", {"k": 3}), ("hierarchical", {"k": 3}), ("hierarchical", {"k": 3, "linkage": "average"}),
    ("hierarchical", {"k": 3, "linkage": "complete"}), ("dbscan", {"eps": 1.5}), ("mean_shift", {}),
    ("spectral", {"k": 3})])
def test_blobs_are_found(blobs, name, params):
    assert _same_partition(flows.cluster(blobs, name, **params))


def test_micro_clusters_keep_the_blobs(blobs):
    assert _same_partition(clustering.hierarchical(blobs, 3, limit=20))


def test_elbow_falls(blobs):
    rows = flows.elbow(blobs, 4, starts=2).orderBy("k").collect()
    assert [r.k for r in rows] == [2, 3, 4]
    assert rows[0].inertia > rows[1].inertia > rows[2].inertia
    assert max(rows, key=lambda r: r.silhouette).k == 3


def test_planted_outliers_score_high(spark):
    df = spark.range(1000).select(
        "id", *[(F.randn(seed=i) + F.when(F.col("id") < 12, 5.0).otherwise(0.0)).alias(f"x{i}") for i in range(6)]).cache()
    forest = isolation.IsolationForest.fit(df, [f"x{i}" for i in range(6)], "id", trees=40)
    scored = forest.score(df).cache()
    ends = scored.agg(F.min("anomaly_score").alias("a"), F.max("anomaly_score").alias("b")).first()
    assert 0 < ends.a < ends.b < 1
    limit = scored.agg(F.percentile("anomaly_score", F.lit(0.9)).alias("p")).first().p
    assert scored.filter(f"id < 12 AND anomaly_score > {limit}").count() == 12
    again = isolation.IsolationForest.fit(df.repartition(7), [f"x{i}" for i in range(6)], "id", trees=40)
    assert again.score(df).join(scored.select("id", F.col("anomaly_score").alias("o")), "id").filter(
        "anomaly_score <> o").count() == 0


def test_smaller_is_better_ranks_first(spark):
    assert tuning.score_of({"rmse": 1.0}, "rmse") > tuning.score_of({"rmse": 2.0}, "rmse")
    assert tuning.score_of({"r2": 0.5}, "r2") > tuning.score_of({"r2": 0.1}, "r2")


def test_grid_search_falls_back(signal):
    train, _ = signal
    best, tried = tuning.grid_search("logistic", train, "classification", "roc_auc", 3, grid={"C": ["broken"]})
    assert best == {} and tried[0]["mean"] is None


def test_mean_shift_spreads_a_large_table(blobs, monkeypatch):
    """A table stored in one file does not leave every round to one task; the groups stay the same."""
    monkeypatch.setattr(clustering, "SPREAD_ROWS", 100)
    parts = []
    monkeypatch.setattr(clustering, "spread", lambda df, key, whole=clustering.spread: parts.append(whole(df, key)) or parts[-1])
    out = clustering.mean_shift(blobs.coalesce(1), bandwidth=2.0)
    groups = out.groupBy("truth").agg(F.countDistinct("cluster").alias("n"), F.min("cluster").alias("c")).collect()
    assert all(g.n == 1 for g in groups) and len({g.c for g in groups}) == 3
    assert [p.rdd.getNumPartitions() > 1 for p in parts] == [True]


def test_boosting_rows_are_stored_once_as_blocks(spark, signal, monkeypatch):
    """Ten rounds read the blocks of the first pass; weights that no round reads are not written."""
    from tallyforge.operators import boosting

    stored, keep = [], boosting.materialise
    monkeypatch.setattr(boosting, "materialise", lambda df: stored.append(keep(df)) or stored[-1])
    train, _ = signal
    rows = train.select("features", F.col("value").alias("label")).repartition(3)
    learners.AdaBoostRegressor(10).fit(rows)
    assert [df.count() for df in stored] == [3]


@pytest.fixture(scope="module")
def steps(spark):
    """Rows of three features with zeros, copies and a constant; the label follows two of them."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(9)
    x = np.stack([rng.integers(-40, 41, 700) / 8.0, rng.integers(0, 2, 700), np.full(700, 3.0)], axis=1)
    y = np.sin(x[:, 0]) * 50.0 + 9.0 * x[:, 1] + rng.normal(size=700)
    rows = [(i, float(y[i]), [float(v) for v in x[i]]) for i in range(700)]
    df = spark.createDataFrame(rows, "key long, label double, x array<double>")
    return df.withColumn("features", array_to_vector(F.col("x"))).repartition(3, "key").cache()


@pytest.mark.parametrize("cells,gathered,bins", [(2 ** 21, 2 ** 18, 32), (2 ** 21, 0, 32), (0, 0, 32), (2 ** 21, 2 ** 18, 256), (0, 0, 256)])
def test_gradient_boosting_grows_the_trees_of_spark(steps, monkeypatch, cells, gathered, bins):
    """Sums by cell, on the driver or in blocks, and blocks of rows predict what Spark's trees predict."""
    from pyspark.ml.regression import GBTRegressor
    from tallyforge.operators import boosting

    monkeypatch.setattr(boosting, "CELLS", cells)
    monkeypatch.setattr(boosting, "GATHERED_CELLS", gathered)
    name, depth, step = ("gradient_boosting", 3, 0.1) if bins == 32 else ("boosted_lgbm", 5, 0.1)
    model = learners.build(name, "regression", 700, n_estimators=3).fit(steps)
    assert isinstance(model, boosting.GradientBoostingModel)
    spark_model = GBTRegressor(maxIter=3, maxDepth=depth, stepSize=step, maxBins=bins, seed=learners.SEED).fit(steps)
    own = model.transform(steps).select("key", "prediction")
    other = spark_model.transform(steps).select("key", F.col("prediction").alias("p"))
    assert own.join(other, "key").filter("abs(prediction - p) < 1e-9").count() == 700
    assert abs(model.importances - spark_model.featureImportances.toArray()).max() < 1e-9


def test_gradient_boosting_takes_the_thresholds_of_a_sample_like_spark(spark):
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    x = F.array((F.rand(3) * 60).cast("int").cast("double") - 20, F.rand(4))
    df = spark.range(14_000).select(F.col("id").alias("key"), x.alias("x")).withColumn("label", F.sin(F.col("x")[0]) + F.col("x")[1])
    df = df.withColumn("features", array_to_vector("x")).repartition(4, "key").persist()
    own = learners.build("gradient_boosting", "regression", 14_000, n_estimators=2).fit(df).transform(df)
    other = GBTRegressor(maxIter=2, maxDepth=3, stepSize=0.1, seed=learners.SEED).fit(df).transform(df).select("key", F.col("prediction").alias("p"))
    assert own.join(other, "key").filter("abs(prediction - p) < 1e-9").count() == 14_000
    df.unpersist()


def test_gradient_boosting_passes_over_rows_once(steps, monkeypatch):
    """The number of passes over the rows does not grow with the rounds."""
    from tallyforge.operators import boosting

    passes, keep = [], boosting.summed
    monkeypatch.setattr(boosting, "summed", lambda *a: passes.append(1) or keep(*a))
    monkeypatch.setattr(boosting, "materialise", lambda df: pytest.fail("rows are stored"))
    learners.build("gradient_boosting", "regression", 700, n_estimators=30).fit(steps)
    assert passes == [1]


@pytest.mark.parametrize("bad", [None, float("nan"), float("inf")])
def test_gradient_boosting_refuses_labels_that_are_no_numbers(steps, bad):
    rows = steps.withColumn("label", F.when(F.col("key") == 5, F.lit(bad).cast("double")).otherwise(F.col("label")))
    with pytest.raises(Exception, match="labels must not be"):
        learners.build("gradient_boosting", "regression", 700, n_estimators=2).fit(rows)
