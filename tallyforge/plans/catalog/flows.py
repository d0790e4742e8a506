from __future__ import annotations

import os
import uuid

from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tallyforge.functions.hashing import hash_bucket
from tallyforge.operators import clustering, isolation, learners, registry
from tallyforge.operators.drift import value_profile
from tallyforge.operators.prepare import Preparation, Scaler
from tallyforge.plans import automl, flows
from tallyforge.plans.catalog.base import SCORED_EVENTS, labelled_documents, query, scored_events
from tallyforge.session import materialise, shared_folder, spread
from tallyforge.streaming import jobs


def vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("key"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


def customer_vectors(t):
    c = t.customer.select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("c_nationkey"))
    scaled = Scaler.fit(c, ["c_acctbal", "c_nationkey"]).transform(c)
    return flows.as_vectors(scaled, ["c_acctbal", "c_nationkey"], "c_custkey")


@query("clu_kmeans")
def clu_kmeans(t):
    return clustering.renumber(clustering.with_kmeans(vectors(t), 10, starts=4)).select("key", "cluster")


@query("clu_hierarchical")
def clu_hierarchical(t):
    return clustering.renumber(clustering.hierarchical(vectors(t), 10)).select("key", "cluster")


@query("clu_meanshift")
def clu_meanshift(t):
    return clustering.renumber(clustering.mean_shift(customer_vectors(t), bandwidth=0.8)).select("key", "cluster")


@query("clu_spectral")
def clu_spectral(t):
    return clustering.renumber(clustering.spectral(vectors(t), 4)).select("key", "cluster")


@query("elbow_curve")
def elbow_curve(t):
    return flows.elbow(vectors(t), 4, starts=2)


@query("clu_tune")
def clu_tune(t):
    tried = flows.tune_clusters(customer_vectors(t), "hierarchical", {"k": [2, 3], "linkage": ["ward", "average"]})
    return t.spark.createDataFrame(
        [(i + 1, r["k"], r["linkage"], round(r["silhouette"], 6)) for i, r in enumerate(tried)],
        "rank int, k int, linkage string, silhouette double")


@query("clu_leaderboard")
def clu_leaderboard(t):
    return flows.cluster_leaderboard(customer_vectors(t), ["kmeans", "dbscan", "hierarchical"], k=4, eps=0.1, starts=2)


@query("automl_cluster", "SELECT count(*) AS n_rows, 1 AS chosen_once, 1 AS useful FROM customer")
def automl_cluster(t):
    """Every customer in one cluster, one number of clusters, and a silhouette above zero."""
    out = flows.automl_cluster(t.customer.select("c_custkey", "c_acctbal", F.col("c_nationkey").cast("double").alias("nation")), "c_custkey")
    return out.agg(F.count("cluster").alias("n_rows"), F.count_distinct("k").cast("int").alias("chosen_once"),
                   (F.max("silhouette") > 0).cast("int").alias("useful"))


@query("segment_pipeline")
def segment_pipeline(t):
    return flows.segment_pipeline(t.events.drop("event_id"), k=4, starts=2).profile.select(
        "segment", "segment_size", "segment_share_pct", "value_mean", "value_count")


@query("iforest_fit")
def iforest_fit(t):
    forest = _forest(t)[0]
    rows = [(i, len(n["feature"]), int((n["feature"] >= 0).sum()), round(float(n["path"].max()), 6)) for i, n in enumerate(forest.nodes)]
    return t.spark.createDataFrame(rows, "tree int, nodes int, splits int, longest_path double")


def _forest(t, trees=50):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    key = F.xxhash64(*[F.col(c) for c in t.lineitem.columns])
    rows = t.lineitem.select(key.alias("key"), "l_orderkey", "l_linenumber", *columns)
    return isolation.IsolationForest.fit(rows, columns, "key", trees=trees), rows


@query("iforest_score")
def iforest_score(t):
    forest, rows = _forest(t)
    scored = forest.score(spread(rows, "key"))
    return scored.select("l_orderkey", "l_linenumber", F.round("anomaly_score", 6).alias("anomaly_score"))


@query("anomaly_pipeline")
def anomaly_pipeline(t):
    found = flows.anomaly_pipeline(t.events, "event_id", trees=50)
    return found.rows.select("event_id", "value", F.round("anomaly_score", 6).alias("anomaly_score"))


@query("anomaly_pipeline_tabular")
def anomaly_pipeline_tabular(t):
    found = flows.anomaly_pipeline(t.part.select("p_partkey", "p_size", "p_retailprice"), "p_partkey", mode="Tabular", method="local_outlier_factor")
    return found.importance.withColumn("importance", F.round("importance", 6))


def _quick(models, **more):
    return automl.Settings(models, "roc_auc", cv="None", params={"n_estimators": 20, "max_depth": 5}, **more)


@query("automl_supervised")
def automl_supervised(t):
    return automl.automl_supervised(labelled_documents(t), "quality", "doc_id", _quick(["random_forest", "logistic"])).leaderboard


@query("automl_churn")
def automl_churn(t):
    return automl.automl_churn(labelled_documents(t, "toxic"), "toxic", "doc_id", _quick(["random_forest", "logistic"], imbalance="smote")).leaderboard


@query("upsell_pipeline")
def upsell_pipeline(t):
    out = flows.upsell_pipeline(labelled_documents(t, "toxic"), "toxic", "doc_id", settings=_quick(["logistic"], imbalance="class_weight"))
    return out.withColumn("score", F.round("score", 6))


@query("propensity_pipeline")
def propensity_pipeline(t):
    out = flows.propensity_pipeline(labelled_documents(t), "quality", "doc_id", settings=_quick(["logistic"]))
    return out.withColumn("score", F.round("score", 6))


# -- registry and streams --------------------------------------------------------------------------

@query("dataset_fingerprint", "SELECT 1 AS same_when_shuffled, 1 AS differs_after_edit")
def dataset_fingerprint(t):
    first = registry.fingerprint(t.customer)
    moved = registry.fingerprint(t.customer.repartition(7, "c_nationkey"))
    edited = registry.fingerprint(t.customer.withColumn(
        "c_acctbal", F.when(F.col("c_custkey") == 1, F.col("c_acctbal") + 0.01).otherwise(F.col("c_acctbal"))))
    return t.spark.createDataFrame([(int(first == moved), int(first != edited))], "same_when_shuffled int, differs_after_edit int")


def _event_models(t) -> dict:
    """A pipeline of every kind that a registry has to store: Spark's own stages, a fitted preparation
    with a model of this library, a margin model, a kernel machine, neighbours' training rows, a forest."""
    assembled = VectorAssembler(inputCols=["value", "user_id"], outputCol="features")
    prepared = Preparation(["value", "user_id"], ["event_type"], scaler="standard")
    return {
        "logistic": ("classification", [assembled, LogisticRegression(maxIter=50)]),
        "gaussian_nb": ("classification", [prepared, learners.GaussianBayes()]),
        "adaboost": ("classification", [prepared, learners.AdaBoost(5)]),
        "linear_svc": ("classification", [prepared, LinearSVC(maxIter=30)]),
        "isolation_forest": ("anomaly", [isolation.Isolation(["value", "user_id"], "event_id", trees=20)]),
    }


def _trainer(t, name: str):
    """All events, a registry, and a function that trains the named model or finds it there."""
    events = scored_events(t).select("event_id", "value", "user_id", "event_type", "ts", F.col("label").cast("double").alias("label"))
    task, stages = _event_models(t)[name]
    store = registry.Registry(t.spark, os.path.join(shared_folder(t.spark), f"models-{uuid.uuid4().hex}"))
    train = lambda: store.train(events, Pipeline(stages=stages), name, task, ["value", "user_id", "event_type"], {"name": name})
    return events, store, train


@query("model_bundle", """SELECT name, task, count(*) AS n_rows, 0::bigint AS n_differ, 1 AS reused, 1 AS same_path, 1::bigint AS entries
  FROM events, (VALUES ('logistic', 'classification'), ('gaussian_nb', 'classification'), ('adaboost', 'classification'),
    ('linear_svc', 'classification'), ('isolation_forest', 'anomaly')) AS m(name, task) GROUP BY name, task""")
def model_bundle(t):
    """Every kind of model stored, found again for the same data and settings, reloaded, and its scores
    over all rows compared with those of the model as it was fitted."""
    rows = []
    for name, (task, _) in _event_models(t).items():
        events, store, train = _trainer(t, name)
        first, again = train(), train()
        fitted = store.fitted[first.path]
        pairs = registry.scored_by(fitted, events).select("event_id", F.col("score").alias("a")).join(
            registry.score_batch(events, again).select("event_id", F.col("score").alias("b")), "event_id")
        found = pairs.agg(F.count("*").alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("differ")).first()
        rows.append((name, task, found.n, found.differ, int(again.reused), int(again.path == first.path), store.entries().count()))
    return t.spark.createDataFrame(
        rows, "name string, task string, n_rows bigint, n_differ bigint, reused int, same_path int, entries bigint")


# scores of the stored preparation and normal densities, stated in full
_STORED_SCORES = f"""WITH e AS (SELECT event_id, label, event_type, (value - avg(value) OVER ()) / stddev_pop(value) OVER () AS value,
  (user_id - avg(user_id::double) OVER ()) / stddev_pop(user_id::double) OVER () AS user_id FROM {SCORED_EVENTS}),
k AS (SELECT DISTINCT event_type AS kind FROM events),
v AS (SELECT event_id, label, '0' AS f, value AS x FROM e UNION ALL SELECT event_id, label, '1', user_id FROM e
  UNION ALL SELECT event_id, label, 'kind ' || kind, (event_type = kind)::int::double FROM e, k),
p AS (SELECT label, ln(count(*) / (SELECT count(*) FROM e)::double) AS p FROM e GROUP BY label),
c AS (SELECT label, f, avg(x) AS m, var_pop(x) + (SELECT 1e-9::double * max(w) FROM (SELECT var_pop(x) AS w FROM v GROUP BY f)) AS w FROM v GROUP BY label, f),
s AS (SELECT v.event_id, c.label, any_value(p.p) - sum(ln(2 * pi() * c.w) / 2 + (x - m) * (x - m) / (2 * c.w)) AS s
  FROM v JOIN c ON v.f = c.f JOIN p ON p.label = c.label GROUP BY v.event_id, c.label),
d AS (SELECT event_id, max(s) FILTER (label = 1) - max(s) FILTER (label = 0) AS d FROM s GROUP BY event_id)
SELECT event_id, (d > 0)::int::double AS prediction, round(1 / (1 + exp(-d)), 6) AS score FROM d"""


@query("score_batch", _STORED_SCORES)
def score_batch(t):
    events, _, train = _trainer(t, "gaussian_nb")
    return registry.score_batch(events, train()).select("event_id", "prediction", F.round("score", 6).alias("score"))


@query("score_anomaly")
def score_anomaly(t):
    """Scores and labels of a stored forest."""
    events, _, train = _trainer(t, "isolation_forest")
    return registry.score_batch(events, train()).select("event_id", F.col("prediction").cast("int").alias("prediction"), F.round("score", 6).alias("score"))


SLICES = 3


def _arrivals(t) -> str:
    return os.path.join(shared_folder(t.spark), f"arriving-{uuid.uuid4().hex}")


def _slice(df, i: int):
    return df.filter(hash_bucket("event_id", 11, SLICES) == i).drop("ts")


def _arriving(t, df):
    """All events written slice by slice, as if they had arrived one after another."""
    folder = _arrivals(t)
    for i in range(SLICES):
        _slice(df, i).write.mode("append").parquet(folder)
    return folder


def _streamed(t, events, bundle):
    folder = _arriving(t, events)
    out = f"{folder}-scored"
    jobs.score_stream(t.spark, bundle, folder, events.drop("ts").schema, out, f"{folder}-state", ["event_id"], files_per_batch=2)
    return t.spark.read.parquet(out)


@query("score_stream", _STORED_SCORES)
def score_stream(t):
    events, _, train = _trainer(t, "gaussian_nb")
    return _streamed(t, events, train()).select("event_id", "prediction", F.round("score", 6).alias("score"))


@query("score_margin")
def score_margin(t):
    """A stored margin model: the score of every row alike in the batch, in the stream and in a part."""
    events, _, train = _trainer(t, "linear_svc")
    bundle = train()
    batch = registry.score_batch(events, bundle).select("event_id", F.round("score", 9).alias("batch_score"))
    stream = _streamed(t, events, bundle).select("event_id", F.round("score", 9).alias("stream_score"))
    part = registry.score_batch(events.filter("event_type = 'click'"), bundle).select("event_id", F.round("score", 9).alias("part_score"))
    return batch.join(stream, "event_id").join(part, "event_id", "left")


@query("drift_stream")
def drift_stream(t):
    """Three slices of the events against all of them, each when it has arrived, in however many files."""
    events = t.events.select("event_id", "user_id", "value", "ts")
    folder, reference = _arrivals(t), events.drop("ts")
    profile = materialise(value_profile(reference))
    for i in range(SLICES):
        _slice(events, i).write.mode("append").parquet(folder)
        jobs.drift_stream(t.spark, reference, folder, f"{folder}-reports", f"{folder}-state", None, profile)
    return jobs.read_reports(t.spark, f"{folder}-reports")
