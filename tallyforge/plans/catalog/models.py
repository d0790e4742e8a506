from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tallyforge.operators import learners, splits
from tallyforge.operators.imbalance import balanced_weights, weight_column
from tallyforge.operators.prepare import fit_plan
from tallyforge.plans import tuning
from tallyforge.plans.catalog.base import labelled_documents, query, sql_bucket
from tallyforge.session import spread

_TEST = sql_bucket("{k}", 42, 1_000_000) + " < 200000"


def quality_rows(t, target="quality"):
    """All labelled documents prepared for a two-class model: train, test and the feature names."""
    df = splits.stratified_split(labelled_documents(t, target), "doc_id", target)
    train = df.filter("is_test = 0")
    plan = fit_plan(train, ["n_chars"], ["lang", "source"], scaler="standard")
    ready = plan.transform(df).select(
        F.col("doc_id").alias("key"), F.col(target).cast("double").alias("label"), "features", "is_test")
    return ready.filter("is_test = 0").drop("is_test"), ready.filter("is_test = 1").drop("is_test"), plan.names


def status_rows(t):
    """All orders prepared for a three-class model of the order status."""
    df = splits.random_split(t.orders, "o_orderkey")
    plan = fit_plan(df.filter("is_test = 0"), ["o_totalprice", "o_custkey"], ["o_orderpriority"], scaler="standard")
    codes = F.coalesce(*[F.when(F.col("o_orderstatus") == s, F.lit(float(i))) for i, s in enumerate("FOP")])
    ready = plan.transform(df).select(F.col("o_orderkey").alias("key"), codes.alias("label"), "features", "is_test")
    return ready.filter("is_test = 0").drop("is_test"), ready.filter("is_test = 1").drop("is_test"), plan.names


def price_rows(t):
    """All order lines prepared for a regression of the price; the key is the hash of the line."""
    key = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    df = splits.random_split(t.lineitem.withColumn("key", key), "key")
    plan = fit_plan(df.filter("is_test = 0"), ["l_quantity", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"], scaler="standard")
    ready = plan.transform(df).select("key", F.col("l_extendedprice").alias("label"), "features", "is_test")
    return ready.filter("is_test = 0").drop("is_test"), ready.filter("is_test = 1").drop("is_test"), plan.names


def fitted(t, name, task, rows, classes=2, **params):
    """A model and its predictions over the test rows."""
    train, test, _ = rows(t)
    train = spread(train, "key").persist()
    model = learners.build(name, task, train.count(), classes, **params).fit(train)
    train.unpersist()
    return model, model.transform(test)


def _metric_rows(t, name, task, rows, classes=2, **params):
    """Every metric over the test rows."""
    _, scored = fitted(t, name, task, rows, classes, **params)
    found = tuning.evaluate(scored, task, classes, 1)
    return t.spark.createDataFrame(
        [(name, k, None if v is None else round(float(v), 6)) for k, v in found.items()], "model string, metric string, value double")


# The ensembles run with 20 rounds here; the library default is 100.
_CLASSIFIERS = {
    "cls_logistic": ("logistic", quality_rows, {}),
    "cls_tree": ("decision_tree", status_rows, {"classes": 3, "max_depth": 8}),
    "cls_forest": ("random_forest", quality_rows, {"n_estimators": 20}),
    "cls_gbt": ("gradient_boosting", quality_rows, {"n_estimators": 20}),
    "cls_adaboost": ("adaboost", quality_rows, {"n_estimators": 20}),
    "cls_svm": ("svm", quality_rows, {}),
    "cls_boosted_hist": ("boosted_xgb", quality_rows, {"n_estimators": 20}),
}
_REGRESSORS = {
    "reg_tree": ("decision_tree", {"max_depth": 8}),
    "reg_forest": ("random_forest", {"n_estimators": 20, "max_depth": 8}),
    "reg_gbt": ("gradient_boosting", {"n_estimators": 20}),
    "reg_adaboost": ("adaboost", {"n_estimators": 10}),
    "reg_svr": ("svm", {}),
    "reg_boosted_hist": ("boosted_lgbm", {"n_estimators": 20}),
}


def _register(key, name, task, rows, params):
    @query(key)
    def run(t):
        return _metric_rows(t, name, task, rows, **params)


for _key, (_name, _rows, _params) in _CLASSIFIERS.items():
    _register(_key, _name, "classification", _rows, _params)
for _key, (_name, _params) in _REGRESSORS.items():
    _register(_key, _name, "regression", price_rows, _params)


@query("cls_gaussian_nb", f"""WITH v AS (SELECT vec_id, label, unnest(embedding)::double AS x, unnest(range(len(embedding))) AS i FROM embeddings),
tr AS (SELECT * FROM v WHERE NOT {_TEST.format(k='vec_id')}),
p AS (SELECT label, ln(count(*) / (SELECT count(*) FROM tr)::double) AS p FROM tr GROUP BY label),
c AS (SELECT label, i, avg(x) AS m, var_pop(x) AS v FROM tr GROUP BY label, i),
e AS (SELECT 1e-9::double * max(v) AS e FROM (SELECT var_pop(x) AS v FROM tr GROUP BY i)),
s AS (SELECT v.vec_id, c.label, any_value(p.p) - sum(ln(2 * pi() * (c.v + e)) / 2 + (x - m) * (x - m) / (2 * (c.v + e))) AS s
  FROM v JOIN c ON v.i = c.i JOIN p ON p.label = c.label, e WHERE {_TEST.format(k='vec_id')} GROUP BY v.vec_id, c.label)
SELECT vec_id AS "key", label::double AS prediction FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) = 1""")
def cls_gaussian_nb(t):
    x = F.col("embedding").cast("array<double>")
    v = splits.random_split(t.embeddings.select(F.col("vec_id").alias("key"), F.col("label").cast("double").alias("label"), array_to_vector(x).alias("features")), "key")
    model = learners.GaussianBayes().fit(v.filter("is_test = 0"))
    return model.transform(v.filter("is_test = 1")).select("key", "prediction")


@query("reg_linear", """SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem""")
def reg_linear(t):
    df = t.lineitem.select(array_to_vector(F.array("l_quantity")).alias("features"), F.col("l_extendedprice").alias("label"))
    model = learners.build("linear", "regression", 0).fit(df)
    row = (round(float(model.coefficients[0]), 4), round(model.intercept, 2), round(model.summary.r2, 6))
    return t.spark.createDataFrame([row], "slope double, intercept double, r2 double")


@query("predict_proba_or_margin")
def predict_proba_or_margin(t):
    """The three ways to a score: probability, scaled decision value, plain prediction."""
    train, test, _ = quality_rows(t)
    model = learners.build("logistic", "classification", train.count()).fit(train)
    out = model.transform(test)
    ways = {"probability": [], "decision": ["probability"], "prediction": ["probability", "rawPrediction"]}
    scored = []
    for way, without in ways.items():
        scale = learners.ScoreScale.fit(model.transform(train).drop(*without))
        scored.append(scale.transform(out.drop(*without)).select(F.lit(way).alias("way"), "key", F.round("score", 6).alias("score")))
    return scored[0].unionByName(scored[1]).unionByName(scored[2])


@query("weighted_logistic")
def weighted_logistic(t):
    """The rare class weighted up."""
    train, test, _ = quality_rows(t, "toxic")
    train = train.withColumn("weight", weight_column(balanced_weights(train, "label"), "label"))
    model = learners.build("logistic", "classification", train.count(), weight_col="weight").fit(train)
    found = tuning.evaluate(model.transform(test), "classification")
    return t.spark.createDataFrame([(k, round(float(v), 6)) for k, v in found.items()], "metric string, value double")


@query("cross_validate")
def cross_validate(t):
    train, _, _ = quality_rows(t)
    rows = train.count()
    out = tuning.cross_validate(lambda: learners.build("logistic", "classification", rows), train, "classification", "roc_auc", 5)
    return t.spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(out["values"])], "fold int, roc_auc double")


@query("grid_search")
def grid_search(t):
    train, _, _ = quality_rows(t)
    best, tried = tuning.grid_search("logistic", train, "classification", "roc_auc", 3)
    return t.spark.createDataFrame(
        [(float(r["params"]["C"]), round(r["mean"], 6), int(r["params"] == best)) for r in tried], "c double, roc_auc double, is_best int")


@query("leaderboard")
def leaderboard(t):
    train, test, _ = quality_rows(t)
    done = tuning.train_all(["logistic", "decision_tree", "gaussian_nb"], train, test, "classification", "roc_auc", cv_folds=3, params={"max_depth": 5})
    return tuning.leaderboard(t.spark, done, "classification", "roc_auc")


@query("leaderboard_metrics")
def leaderboard_metrics(t):
    train, test, _ = price_rows(t)
    done = tuning.train_all(["linear", "decision_tree"], train, test, "regression", "rmse", params={"max_depth": 5})
    return tuning.metric_table(t.spark, done)


@query("feature_importance")
def feature_importance(t):
    train, _, names = quality_rows(t)
    rows = train.count()
    parts = []
    for name, params in (("random_forest", {"n_estimators": 20}), ("logistic", {})):
        model = learners.build(name, "classification", rows, **params).fit(train)
        parts += [(name, f, round(v, 6)) for f, v in learners.importance(model, names)]
    return t.spark.createDataFrame(parts, "model string, feature string, importance double")
