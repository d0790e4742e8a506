import os

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tallyforge.operators.drift import drift_report
from tallyforge.operators.registry import Registry, fingerprint, score_batch
from tallyforge.plans import automl, flows
from tallyforge.plans.catalog.base import scored_events
from tallyforge.sources.delimited import detect_separator, read_delimited, write_delimited
from tallyforge.streaming import jobs


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_delimited(spark, tmp_path, sep):
    path = tmp_path / "data.csv"
    lines = ["a,b,c", "1,x,2.5", "2,y", "3,z,4.5,9,9", '4,"u""v",NaN', "5,w,"]
    path.write_text("\n".join(lines).replace(",", sep))
    assert detect_separator(spark, str(path)) == sep
    rows = read_delimited(spark, str(path), None).orderBy("a").collect()
    assert [(r.a, r.b, r.c) for r in rows] == [(1, "x", 2.5), (2, "y", None), (4, 'u"v', None), (5, "w", None)]


def test_vectors_are_written_as_columns(spark, blobs, tmp_path):
    write_delimited(blobs.select("key", "features"), str(tmp_path / "out"))
    assert read_delimited(spark, str(tmp_path / "out")).columns == ["key", "features_0", "features_1"]


@pytest.fixture(scope="module")
def stored(spark, tables, tmp_path_factory):
    events = scored_events(tables).select("event_id", "value", "user_id", F.col("label").cast("double").alias("label"))
    steps = Pipeline(stages=[VectorAssembler(inputCols=["value", "user_id"], outputCol="features"), LogisticRegression()])
    store = Registry(spark, str(tmp_path_factory.mktemp("models")))
    train = lambda force=False: store.train(events, steps, "logistic", "classification", ["value", "user_id"], {}, force=force)
    return events, store, train


def test_registry_reuses_and_reloads(stored):
    events, store, train = stored
    first, again, forced = train(), train(), train(True)
    assert not first.reused and again.reused and again.path == first.path and not forced.reused
    assert store.entries().count() == 2
    a = score_batch(events, first).select("event_id", "score").collect()
    b = score_batch(events, again).select("event_id", "score").collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    with pytest.raises(ValueError):
        score_batch(events.drop("value"), first)


def test_fingerprint(tables):
    c = tables.customer
    assert fingerprint(c) == fingerprint(c.repartition(5))
    assert fingerprint(c) != fingerprint(c.withColumn("c_name", F.concat("c_name", F.lit("x"))))
    assert fingerprint(c) != fingerprint(c.union(c.limit(1)))


def test_score_stream_equals_batch_and_restarts_clean(spark, stored, tmp_path):
    events, _, train = stored
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    events.repartition(3).write.parquet(folder)
    for _ in range(2):
        jobs.score_stream(spark, train(), folder, events.schema, out, state, ["event_id"])
    got = sorted(map(tuple, spark.read.parquet(out).select("event_id", "score").collect()))
    want = sorted(map(tuple, score_batch(events, train()).select("event_id", "score").collect()))
    assert got == want


def test_drift_stream_equals_batch(spark, tables, tmp_path):
    events = tables.events.select("event_id", "user_id", "value")
    folder, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    late = events.filter("value > 40")
    late.coalesce(1).write.parquet(folder)
    for _ in range(2):
        jobs.drift_stream(spark, events, folder, out, state)
    got = sorted(map(tuple, jobs.read_reports(spark, out).drop("batch").collect()))
    assert got == sorted(map(tuple, drift_report(events, late).collect()))
    assert os.path.isdir(out)


def test_segment_and_anomaly_flows(tables):
    found = flows.segment_pipeline(tables.events.drop("event_id"), k=3, starts=1)
    assert found.entity == "user_id"
    assert found.profile.agg(F.sum("segment_size")).first()[0] == tables.events.select("user_id").distinct().count()
    odd = flows.anomaly_pipeline(tables.events, "event_id", trees=20, contamination=0.1)
    assert odd.mode["resolved"] == "Time-series" and odd.mode["column"] == "ts"
    row = odd.summary.first()
    assert row.total == tables.events.count() and 0.08 * row.total <= row.anomalies <= 0.1 * row.total


def test_automl_runs_end_to_end(tables):
    settings = automl.Settings(["logistic", "decision_tree"], "roc_auc", cv=2, params={"max_depth": 3})
    docs = tables.documents.join(tables.labels, "doc_id").select("doc_id", "n_chars", "lang", "source", "quality")
    result = automl.automl_supervised(docs, "quality", "doc_id", settings)
    ranks = result.leaderboard.orderBy("rank").collect()
    assert [r.rank for r in ranks] == [1, 2] and ranks[0].model == result.best
    assert all(r.cv_mean is not None for r in ranks)
    assert result.scored.columns[0] == "doc_id"


def test_drift_stream_takes_empty_files_and_slices_of_several_files(spark, tmp_path):
    """A file without rows gives an empty report, and a slice counts as one batch in however many files."""
    reference = spark.range(100).selectExpr("id", "id * 1.0D AS v")
    folder, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    reference.filter("id < 0").coalesce(1).write.parquet(folder)
    jobs.drift_stream(spark, reference, folder, out, state)
    for low in (0, 50):
        reference.filter(f"id >= {low} AND id < {low} + 50").repartition(3).write.mode("append").parquet(folder)
        jobs.drift_stream(spark, reference, folder, out, state, None)
    rows = jobs.read_reports(spark, out).collect()
    assert sorted((r.batch, r.feature) for r in rows) == [(1, "id"), (1, "v"), (2, "id"), (2, "v")]
    assert all(r.ks_stat == 0.5 for r in rows)
