"""Cases that the test tables do not hold: NaN, equal rows, sub-millisecond times, wide tables, long
baskets, three classes, and results that must not change with the size of the table."""

import datetime
import math

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tallyforge.operators import clustering, features, prepare, profile, recommend, roles, silhouette
from tallyforge.plans import automl, flows, tuning
from tallyforge.sources.delimited import read_delimited

NAN = float("nan")


@pytest.fixture(scope="module")
def gaps(spark):
    return spark.createDataFrame([(1, 1.0), (2, 3.0), (3, NAN), (4, None)], "k long, x double")


def test_nan_is_missing(gaps):
    assert prepare.means(gaps, ["x"]) == {"x": 2.0}
    assert prepare.medians(gaps, ["x"]) == {"x": 2.0}
    assert [r.x for r in prepare.impute(gaps, ["x"]).orderBy("k").collect()] == [1.0, 3.0, 2.0, 2.0]
    assert prepare.Scaler.fit(gaps, ["x"]).shift == {"x": 2.0}
    assert prepare.choose_scaler(gaps, ["x"]) == "standard"
    missing = profile.missing_by_column(gaps).first()
    assert (missing["column"], missing["missing"]) == ("x", 2)
    assert profile.overview(gaps).first()["missing_cells"] == 2
    both = gaps.withColumn("y", F.col("x") * 2)
    assert profile.correlation_pairs(both, ["x", "y"]).first()["correlation"] == 1.0
    assert features.judge_numeric(gaps, ["k"])[0]["variance"] == 1.0


def test_rows_a_microsecond_apart_are_different(spark):
    moment = datetime.datetime(2024, 1, 1, 0, 0, 0, 5)
    rows = [(moment, "a", 1.0), (moment + datetime.timedelta(microseconds=1), "a", 1.0), (moment, "a", 1.0),
            (moment, None, 1.0), (moment, "", 1.0)]
    df = spark.createDataFrame(rows, "t timestamp, s string, x double")
    assert profile.overview(df).first()["duplicate_rows"] == 1


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "data.csv"
    path.write_text('a,b\n1,"one\ntwo"\n2,three\n')
    rows = read_delimited(spark, str(path)).orderBy("a").collect()
    assert [(r.a, r.b) for r in rows] == [(1, "one\ntwo"), (2, "three")]


def test_silhouette_has_one_definition(blobs):
    points = blobs.withColumn("cluster", F.col("truth"))
    small = silhouette.silhouette(points, "cluster")
    assert silhouette.silhouette(points.union(points).union(points), "cluster") == pytest.approx(small, abs=0.01)
    wide = points.withColumn("features", array_to_vector(F.concat("x", F.array_repeat(F.lit(0.0), 20_000))))
    assert silhouette.silhouette(wide, "cluster") == pytest.approx(small, abs=1e-9)  # beyond the old limit


def test_micro_clusters_are_the_same_path_at_every_size(blobs):
    for limit in (20, 200):
        found = clustering.hierarchical(blobs, 3, limit=limit)
        assert found.groupBy("truth").agg(F.countDistinct("cluster").alias("k")).filter("k > 1").count() == 0


def test_long_baskets_are_whole(spark, monkeypatch):
    rows = [(u, i) for u in range(3) for i in range(100 + u)]
    df = spark.createDataFrame(rows, "user long, item long")
    basket = recommend.baskets(df, "user", "item")
    assert basket.count() == len(rows)
    whole = recommend.cooccurrence(basket).count()
    assert whole == 101 * 100
    monkeypatch.setattr(recommend, "BASKET_BLOCK", 7)
    cut = recommend.cooccurrence(basket)
    assert cut.count() == whole and cut.filter("support = 3").count() == 100 * 99


def test_as_many_rows_as_asked_for(spark):
    df = spark.range(2000).select(F.col("id").alias("row_id"), (F.col("id") / 2000).alias("score"))
    assert recommend.rank_by_score(df, "score", "row_id", top=1000).count() == 1000


def test_wide_tables_lose_nothing(spark):
    names = [f"c{i}" for i in range(60)]
    df = spark.range(40).select("id", *[(F.hash("id", F.lit(n)) % 7).cast("double").alias(n) for n in names])
    assert len(features.row_statistics(names)) == 6
    assert len(features.select_numeric(df, ["id"])) == 60
    assert profile.box_by_class(df.withColumn("class", F.col("id") % 2), "class").select("feature").distinct().count() == 61
    assert profile.cardinality(df).count() == 61


def test_equal_rows_stay_in_segments(spark):
    rows = [(float(i % 5), float(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "amount double, weight double")
    found = flows.segment_pipeline(df, model="dbscan", eps=0.5, min_samples=3)
    assert found.rows.count() == 60


def test_rows_without_a_time_come_back_unscored(spark):
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, None if i % 10 == 0 else start + datetime.timedelta(hours=i), float(i * i % 97)) for i in range(200)]
    df = spark.createDataFrame(rows, "key long, event_time timestamp_ntz, value double")
    found = flows.anomaly_pipeline(df, "key", trees=10)
    assert found.rows.count() == 200
    assert found.rows.filter("anomaly_score IS NULL AND is_anomaly = 0").count() == 20
    assert found.projection.count() == 180


def test_metric_names(signal):
    assert tuning.metric_name("f1", "classification") == "binary_f1"
    assert tuning.metric_name("f1", "classification", 3) == "f1_weighted"
    assert tuning.metric_name("matthews_corrcoef", "classification") == "mcc"
    assert tuning.metric_name("median_absolute_error", "regression") == "median_ae"
    with pytest.raises(ValueError):
        tuning.train_all(["logistic"], *signal, "classification", "no_such_metric")


def test_adjusted_r2_knows_the_width(signal):
    from tallyforge.operators import learners
    train = signal[0].drop("label").withColumnRenamed("value", "label")
    make = lambda: learners.build("decision_tree", "regression", 400, max_depth=2)
    plain = tuning.cross_validate(make, train, "regression", "r2", 3)["mean"]
    adjusted = tuning.cross_validate(make, train, "regression", "adjusted_r2", 3)["mean"]
    assert adjusted < plain


def test_three_classes_run_through(tables):
    settings = automl.Settings(["logistic", "boosted_xgb"], "roc_auc", cv=2, params={"n_estimators": 2, "max_depth": 3})
    orders = tables.orders.withColumn("later", F.col("o_orderdate") > "1995-06-01").drop("o_orderdate")
    board = automl.automl_supervised(orders, "o_orderstatus", "o_orderkey", settings).leaderboard.collect()
    assert len(board) == 2 and all(0.4 < r["test_value"] <= 1.0 and r["cv_mean"] is not None for r in board)


@pytest.mark.parametrize("metric", ["f1", "precision", "recall"])
def test_churn_metrics_users_pass(tables, metric):
    df = tables.labels.join(tables.documents, "doc_id").select("doc_id", "n_chars", "lang", "quality")
    settings = automl.Settings(["logistic"], metric, cv="None")
    row = automl.automl_churn(df, "quality", "doc_id", settings).leaderboard.first()
    assert not math.isnan(row["test_value"])


def test_automatic_clustering(blobs):
    df = blobs.select("key", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))
    found = flows.automl_cluster(df, "key", ["a", "b"], largest=5)
    assert found.select("k").distinct().collect() == [(3,)] and found.count() == blobs.count()


def test_churn_names(spark):
    empty = lambda *names: spark.createDataFrame([], ", ".join(f"`{n}` int" for n in names))
    assert roles.detect_churn_column(empty("a", "Is Churned", "churn")) == "churn"
    assert roles.detect_churn_column(empty("a", "my_churn_flag")) == "my_churn_flag"


def test_broadcast_is_checked_by_bytes(spark):
    from tallyforge.session import broadcast_if_small
    plan = lambda df: df._jdf.queryExecution().analyzed().toString()
    small = spark.range(100).select(F.repeat(F.lit("x"), 10).alias("s"))
    large = spark.range(100).select(F.repeat(F.lit("x"), 1_000_000).alias("s"))
    assert "strategy=broadcast" in plan(broadcast_if_small(small)) and "strategy=broadcast" not in plan(broadcast_if_small(large))


def test_a_stored_forest_scores_alike(spark, blobs, tmp_path):
    from tallyforge.operators.isolation import IsolationForest
    df = blobs.select("key", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"))
    forest = IsolationForest.fit(df, ["a", "b"], "key", trees=10)
    forest.write().overwrite().save(str(tmp_path / "forest"))
    again = IsolationForest.load(str(tmp_path / "forest"))
    one = {r.key: r.anomaly_score for r in forest.score(df).collect()}
    assert one == {r.key: r.anomaly_score for r in again.score(df).collect()}


def test_a_stored_profile_gives_the_same_drift(tables):
    from tallyforge.operators import drift
    events = tables.events.select("user_id", "value")
    new = events.filter("value > 40")
    direct = drift.drift_report(events, new).collect()
    stored = drift.report_of(drift.paired_profiles(drift.value_profile(events), drift.value_profile(new))).collect()
    assert direct == stored


def test_too_many_levels_are_refused(spark, monkeypatch):
    monkeypatch.setattr(prepare, "MAX_LEVELS", 5)
    df = spark.range(20).select(F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        prepare.levels(df, ["c"])
