import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tallyforge.operators import features, prepare, splits
from tallyforge.operators.ordering import materialise
from tallyforge.operators.roles import binary_target, column_roles


def test_nulls_nan_and_constants(spark):
    df = spark.createDataFrame([(1, 1.0, 3.0, "a"), (2, None, 3.0, None), (3, 4.0, 3.0, "b"), (4, 5.0, 3.0, "b")],
                               "id int, x double, c double, s string")
    filled = prepare.impute(df, ["x"], ["s"], "median")
    row = filled.filter("id = 2").first()
    assert (row.x, row.s) == (4.0, "b")
    scaled = prepare.Scaler.fit(df, ["c"]).transform(df)
    assert {r.c for r in scaled.collect()} == {0.0}
    scaled = prepare.Scaler.fit(df, ["c"], "minmax").transform(df)
    assert {r.c for r in scaled.collect()} == {0.0}


def test_infinities_are_imputed(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),), (float("nan"),), (None,), (3.0,)], "x double")
    assert sorted(r.x for r in prepare.impute_robust(df, ["x"]).collect()) == [1.0, 2.0, 2.0, 2.0, 3.0]


def test_plan_is_fitted_on_training_rows_only(spark, tables):
    df = splits.random_split(tables.customer, "c_custkey")
    train, test = df.filter("is_test = 0"), df.filter("is_test = 1")
    plan = prepare.fit_plan(train, ["c_acctbal"], ["c_mktsegment"], ["c_name"])
    wild = test.withColumn("c_acctbal", F.col("c_acctbal") * 1000).withColumn("c_mktsegment", F.lit("NEW"))
    other = prepare.fit_plan(train, ["c_acctbal"], ["c_mktsegment"], ["c_name"])
    assert plan.scaler == other.scaler and plan.fills == other.fills
    out = plan.transform(wild).withColumn("v", vector_to_array("features"))
    width = len(plan.names)
    for r in out.collect():
        assert len(r.v) == width and all(v == v for v in r.v)
        assert r.v[1:-1] == [0.0] * (width - 2) and r.v[-1] == -1.0  # unseen level, unseen name


def test_stratified_counts_are_exact(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 10 == 0, "rare").otherwise("common").alias("y"))
    out = splits.stratified_split(df, "id", "y", 0.25).groupBy("y").agg(F.sum("is_test").alias("n"))
    assert {r.y: r.n for r in out.collect()} == {"rare": 100, "common": 900}


def test_folds_partition_every_class(spark):
    df = spark.range(1003).select("id", (F.col("id") % 3).alias("y"))
    rows = splits.folds(df, "id", 4, "y").groupBy("y", "fold").count().collect()
    for y in range(3):
        sizes = [r["count"] for r in rows if r.y == y]
        assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1


def test_split_does_not_depend_on_layout(spark):
    df = spark.range(2000)
    one = {r.id for r in splits.random_split(df, "id").filter("is_test = 1").collect()}
    two = {r.id for r in splits.random_split(df.repartition(13), "id").filter("is_test = 1").collect()}
    assert one == two and 300 < len(one) < 500


@pytest.mark.parametrize("values,expected", [
    (["Yes", " no", None], [1, 0, 0]), ([3, 9, 9], [0, 1, 1]), (["a", "b", "b"], [1, 0, 0]),
    (["churned", "maybe", "x"], [1, 0, 0])])
def test_binary_target(spark, values, expected):
    kind = "bigint" if isinstance(values[0], int) else "string"
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, y {kind}")
    out = df.withColumn("l", binary_target(df, "y")).orderBy("i").collect()
    assert [r.l for r in out] == expected


def test_strict_ids_can_be_relaxed(spark):
    df = spark.range(100).select("id", (F.col("id") / 7).alias("x"), F.lit("a").alias("s"))
    assert column_roles(df).ids == ["id", "x"]
    assert column_roles(df, strict_ids=False).ids == ["id"]


def test_projection(spark, blobs):
    out, shares = features.project(blobs, k=2)
    assert shares == sorted(shares, reverse=True) and sum(shares) == pytest.approx(1.0)
    row = out.agg(F.avg("component_1").alias("a"), F.corr("component_1", "component_2").alias("c")).first()
    assert row.a == pytest.approx(0.0, abs=1e-9) and row.c == pytest.approx(0.0, abs=1e-6)


def test_materialise_cuts_lineage(spark):
    df = materialise(spark.range(10).filter("id > 3"))
    assert "Filter" not in df._jdf.queryExecution().optimizedPlan().toString() and df.count() == 6
