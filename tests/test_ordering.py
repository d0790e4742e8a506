import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.operators.ordering import neighbourhood, positions, running_sums
from tallyforge.operators.quantiles import column_quantiles, quantiles
from tallyforge.plans.catalog import QUERIES
from tests.conftest import FOLDER


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_running_sums(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("n"))
    rows = sorted(running_sums(df, [F.desc("k")], {"n": "s"}).collect(), key=lambda r: -r.k)
    assert [r.s for r in rows] == list(np.cumsum([r.k % 7 for r in rows]))


def test_positions_are_dense(spark):
    df = spark.range(3000).select((F.col("id") * 3).alias("k"))
    assert sorted((r.k, r.position) for r in positions(df, ["k"]).collect()) == [(3 * i, i) for i in range(3000)]


def test_neighbourhood_crosses_block_borders(spark):
    df = spark.range(1000).select("id", (F.col("id") * F.col("id") % 97).cast("double").alias("x"))
    made = {"lag": lambda w: F.lag("x").over(w), "mean": lambda w: F.avg("x").over(w.rowsBetween(-4, 0))}
    rows = {r.id: r for r in neighbourhood(df, ["id"], 5, made, block_rows=16).collect()}
    x = [float(i * i % 97) for i in range(1000)]
    assert len(rows) == 1000
    for i in range(1000):
        assert rows[i].lag == (x[i - 1] if i else None)
        assert rows[i]["mean"] == pytest.approx(np.mean(x[max(0, i - 4):i + 1]))


@pytest.mark.parametrize("n", [1, 2, 3, 50, 60_000])
def test_quantiles_with_a_hot_value(spark, n):
    rng = np.random.default_rng(n)
    x = np.where(rng.random(n) < 0.34, 5.0, rng.normal(size=n).round(3))
    df = spark.createDataFrame([(float(v), int(i % 2)) for i, v in enumerate(x)], "x double, g int")
    got = column_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.95, 1.0])["x"]
    assert got == pytest.approx(list(np.quantile(x, [0.0, 0.25, 0.5, 0.95, 1.0])))
    for r in quantiles(df, ["g"], "x", [0.3, 0.9]).collect():
        assert r["quantile"] == pytest.approx(np.quantile(x[r.g::2], r.prob))


@pytest.mark.parametrize("key", ["roc_curve", "pr_curve", "feat_timeseries", "numeric_target", "drift_ks"])
def test_no_single_task_ordering(spark, key):
    assert "SinglePartition" not in plan_of(QUERIES[key](spark, FOLDER))


def test_filters_and_columns_reach_the_scan(spark, tables):
    plan = plan_of(tables.orders.filter("o_orderkey > 5").groupBy("o_orderstatus").count())
    assert "PushedFilters: [IsNotNull(o_orderkey), GreaterThan(o_orderkey,5)]" in plan
    assert "o_totalprice" not in plan.split("== Optimized Logical Plan ==")[1].split("ReadSchema:")[1]


def test_entity_aggregation_is_one_shuffle(spark):
    plan = plan_of(QUERIES["ent_aggregate"](spark, FOLDER)).split("== Physical Plan ==")[1]
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Expand" not in plan
