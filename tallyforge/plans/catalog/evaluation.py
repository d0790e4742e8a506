from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions.columns import scalar_row
from tallyforge.operators import decisions, metrics, profile, splits
from tallyforge.plans.catalog.base import SCORED_EVENTS, query, scored_events, sql_bucket

# -- classes: the order status (three classes) guessed from the price ---------------------------

_GUESS_SQL = """(SELECT o_orderkey, o_orderstatus AS label,
  CASE WHEN o_totalprice < 150000 THEN 'F' WHEN o_totalprice < 350000 THEN 'O' ELSE 'P' END AS prediction FROM orders)"""


def guessed_orders(t):
    price = F.col("o_totalprice")
    guess = F.when(price < 150000, "F").when(price < 350000, "O").otherwise("P")
    return t.orders.select("o_orderkey", F.col("o_orderstatus").alias("label"), guess.alias("prediction"))


def _class_sql(rows: str) -> str:
    return f"""x AS {rows}, n AS (SELECT count(*)::double AS n FROM x),
c AS (SELECT class, sum(s)::double AS s, sum(p)::double AS p, sum(h)::double AS h FROM (
  SELECT label AS class, count(*) AS s, 0 AS p, count_if(label = prediction) AS h FROM x GROUP BY label
  UNION ALL SELECT prediction, 0, count(*), 0 FROM x GROUP BY prediction) GROUP BY class),
m AS (SELECT *, CASE WHEN p > 0 THEN h / p ELSE 0 END AS pr, CASE WHEN s > 0 THEN h / s ELSE 0 END AS re,
  CASE WHEN s + p > 0 THEN 2 * h / (s + p) ELSE 0 END AS f1 FROM c)"""


_CLASS_METRICS = {
    "m_accuracy": ("accuracy", "sum(h) / max(n)"),
    "m_balanced_accuracy": ("balanced_accuracy", "avg(re) FILTER (s > 0)"),
    "m_f1_weighted": ("f1_weighted", "sum(f1 * s) / max(n)"),
    "m_f1_macro": ("f1_macro", "avg(f1)"),
    "m_f1_micro": ("f1_micro", "sum(h) / max(n)"),
    "m_precision_weighted": ("precision_weighted", "sum(pr * s) / max(n)"),
    "m_recall_weighted": ("recall_weighted", "sum(re * s) / max(n)"),
    "m_mcc": ("mcc", "(sum(h) * max(n) - sum(s * p)) / sqrt((max(n) ** 2 - sum(p * p)) * (max(n) ** 2 - sum(s * s)))"),
    "m_cohen_kappa": ("cohen_kappa", "1 - (max(n) - sum(h)) / (max(n) - sum(s * p) / max(n))"),
}


def _register_class_metric(key: str, column: str, formula: str) -> None:
    sql = (f"WITH {_class_sql(_GUESS_SQL)} SELECT 'orders' AS source, round({formula}, 6) AS {column} FROM m, n "
           f"UNION ALL SELECT 'events', * FROM (WITH {_class_sql(SCORED_EVENTS)} SELECT round({formula}, 6) FROM m, n)")

    @query(key, sql)
    def run(t):
        tables = {"orders": guessed_orders(t), "events": scored_events(t)}
        parts = [
            metrics.classification_metrics(df, "label", "prediction").select(
                F.lit(name).alias("source"), F.round(column, 6).alias(column))
            for name, df in tables.items()]
        return parts[0].unionByName(parts[1])


for _key, (_column, _formula) in _CLASS_METRICS.items():
    _register_class_metric(_key, _column, _formula)


@query("m_binary_prf", f"""
SELECT round(tp / nullif(tp + fp, 0)::double, 6) AS precision, round(tp / nullif(tp + fn, 0)::double, 6) AS recall,
  round(2 * tp / (2 * tp + fp + fn)::double, 6) AS f1 FROM (SELECT count_if(label = 1 AND prediction = 1) AS tp,
  count_if(label = 0 AND prediction = 1) AS fp, count_if(label = 1 AND prediction = 0) AS fn FROM {SCORED_EVENTS})""")
def m_binary_prf(t):
    out = metrics.binary_metrics(scored_events(t), "label", "prediction")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("confusion_matrix", f"""
WITH x AS {_GUESS_SQL}, k AS (SELECT label AS c FROM x UNION SELECT prediction FROM x),
n AS (SELECT label, prediction, count(*) AS n FROM x GROUP BY ALL)
SELECT a.c AS label, b.c AS prediction, coalesce(n, 0)::bigint AS n,
  coalesce(round(coalesce(n, 0) * 100.0::double / sum(n) OVER (PARTITION BY a.c), 4), 0.0) AS row_pct
FROM k a CROSS JOIN k b LEFT JOIN n ON n.label = a.c AND n.prediction = b.c""")
def confusion_matrix(t):
    return metrics.confusion_matrix(guessed_orders(t), "label", "prediction")


# -- ranking -------------------------------------------------------------------------------------

_CURVE = f"""s AS (SELECT score, count_if(label = 1) AS pos, count_if(label = 0) AS neg FROM {SCORED_EVENTS} GROUP BY score),
c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
  sum(pos) OVER ()::double AS p, sum(neg) OVER ()::double AS q FROM s)"""


@query("m_roc_auc", f"WITH {_CURVE} SELECT round(sum(neg * (tp - pos / 2.0::double)) / max(p * q), 6) AS roc_auc FROM c")
def m_roc_auc(t):
    return metrics.roc_auc(scored_events(t), "label", "score").select(F.round("roc_auc", 6).alias("roc_auc"))


_THREE = {"F": "1.0::double - o_totalprice / 1000000", "O": "1.0::double - abs(o_totalprice - 250000) / 1000000",
          "P": "o_totalprice / 1000000::double"}


def _one_vs_rest(c: str, score: str) -> str:
    return f"""SELECT '{c}' AS c, round({score}, 3) AS score, count_if(o_orderstatus = '{c}') AS pos,
      count_if(o_orderstatus <> '{c}') AS neg FROM orders GROUP BY 2"""


@query("m_roc_auc_multiclass", f"""
WITH s AS ({' UNION ALL '.join(_one_vs_rest(c, s) for c, s in _THREE.items())}),
r AS (SELECT *, sum(pos) OVER (PARTITION BY c ORDER BY score DESC) AS tp FROM s),
a AS (SELECT c, sum(neg * (tp - pos / 2.0::double)) / (sum(pos)::double * sum(neg)) AS auc, sum(pos)::double AS n FROM r GROUP BY c)
SELECT round(sum(auc * n) / sum(n), 6) AS roc_auc FROM a""")
def m_roc_auc_multiclass(t):
    price = F.col("o_totalprice")
    scores = {"F": 1.0 - price / 1e6, "O": 1.0 - F.abs(price - 250000) / 1e6, "P": price / 1e6}
    df = t.orders.select("o_orderstatus", *[F.round(s, 3).alias(f"s_{c}") for c, s in scores.items()])
    return metrics.roc_auc_multiclass(df, "o_orderstatus", {c: f"s_{c}" for c in scores}).select(
        F.round("roc_auc", 6).alias("roc_auc"))


@query("m_avg_precision", f"WITH {_CURVE} SELECT round(sum(pos * (tp / (tp + fp)::double)) / max(p), 6) AS average_precision FROM c")
def m_avg_precision(t):
    return metrics.average_precision(scored_events(t), "label", "score").select(
        F.round("average_precision", 6).alias("average_precision"))


@query("roc_curve", f"WITH {_CURVE} SELECT score AS threshold, round(fp / q, 6) AS fpr, round(tp / p, 6) AS tpr FROM c")
def roc_curve(t):
    return metrics.roc_curve(scored_events(t), "label", "score")


@query("pr_curve", f"""WITH {_CURVE} SELECT score AS threshold, round(tp / (tp + fp)::double, 6) AS precision,
  round(tp / p, 6) AS recall, round(p / (p + q), 6) AS baseline FROM c""")
def pr_curve(t):
    return metrics.pr_curve(scored_events(t), "label", "score")


_SWEEP = f"""x AS {SCORED_EVENTS}, g AS (SELECT round(i / 100.0::double, 2) AS threshold FROM (SELECT unnest(range(1, 100)) AS i)),
w AS (SELECT threshold, count_if(label = 1 AND score >= threshold) AS tp, count_if(label = 0 AND score >= threshold) AS fp,
  count_if(label = 1 AND score < threshold) AS fn, count_if(label = 0 AND score < threshold) AS tn FROM g, x GROUP BY threshold),
sw AS (SELECT threshold, tp::bigint AS tp, fp::bigint AS fp, fn::bigint AS fn, tn::bigint AS tn,
  round(coalesce(tp / nullif(tp + fp, 0)::double, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::double, 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::double, 0), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn)::double, 6) AS accuracy FROM w)"""
_PROFIT = """SELECT threshold, tp + fp AS targeted, tp * 10000.0::double AS revenue, (tp + fp) * 500.0::double AS cost,
  tp * 10000.0::double - (tp + fp) * 500.0::double AS profit FROM sw"""


@query("threshold_sweep", f"WITH {_SWEEP} SELECT * FROM sw")
def threshold_sweep(t):
    return decisions.threshold_sweep(scored_events(t), "label", "score")


@query("threshold_best_f1", f"WITH {_SWEEP} SELECT * FROM sw ORDER BY f1 DESC, threshold LIMIT 1")
def threshold_best_f1(t):
    return decisions.best_threshold(threshold_sweep(t))


@query("profit_curve", f"WITH {_SWEEP} {_PROFIT}")
def profit_curve(t):
    return decisions.profit_curve(threshold_sweep(t))


@query("profit_optimal_threshold", f"WITH {_SWEEP} SELECT * FROM ({_PROFIT}) ORDER BY profit DESC, threshold LIMIT 1")
def profit_optimal_threshold(t):
    return decisions.profit_optimum(profit_curve(t))


# -- regression: price against the line fitted on quantity ---------------------------------------

REGRESSION = """(SELECT l_orderkey, l_linenumber, l_extendedprice AS y, a * l_quantity + b AS yhat FROM lineitem,
  (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem))"""


def priced_lines(t):
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    line = scalar_row(t.lineitem.agg(F.regr_slope(y, x).alias("a"), F.regr_intercept(y, x).alias("b")))
    return t.lineitem.select("l_orderkey", "l_linenumber", y.alias("y"), (F.lit(line.a) * x + F.lit(line.b)).alias("yhat"))


_R2 = "1 - sum((y - yhat) ** 2) / (var_pop(y) * count(*))"
_REGRESSION_METRICS = {
    "m_r2": ("r2", _R2, 6),
    "m_adjusted_r2": ("adjusted_r2", f"1 - (1 - ({_R2})) * (count(*) - 1) / (count(*) - 2)::double", 6),
    "m_mae": ("mae", "avg(abs(y - yhat))", 4),
    "m_mse": ("mse", "avg((y - yhat) ** 2)", 1),
    "m_rmse": ("rmse", "sqrt(avg((y - yhat) ** 2))", 4),
    "m_mape": ("mape", "avg(abs(y - yhat) / greatest(abs(y), 2.220446049250313e-16))", 6),
    "m_max_error": ("max_error", "max(abs(y - yhat))", 4),
    "m_explained_variance": ("explained_variance", "1 - var_pop(y - yhat) / var_pop(y)", 6),
}


def _register_regression_metric(key: str, column: str, formula: str, digits: int) -> None:
    @query(key, f"SELECT round({formula}, {digits}) AS {column} FROM {REGRESSION}")
    def run(t):
        return metrics.regression_metrics(priced_lines(t), "y", "yhat").select(
            F.round(column, digits).alias(column))


for _key, (_column, _formula, _digits) in _REGRESSION_METRICS.items():
    _register_regression_metric(_key, _column, _formula, _digits)


@query("m_median_ae", f"SELECT round(quantile_cont(abs(y - yhat), 0.5), 4) AS median_ae FROM {REGRESSION}")
def m_median_ae(t):
    return metrics.median_absolute_error(priced_lines(t), "y", "yhat").select(
        F.round("median_ae", 4).alias("median_ae"))


@query("pred_vs_actual_fit", f"""SELECT round(regr_slope(yhat, y), 6) AS slope, round(regr_intercept(yhat, y), 4) AS intercept,
  round({_R2}, 6) AS r2, round(sqrt(avg((y - yhat) ** 2)), 4) AS rmse, count(*) AS n FROM {REGRESSION}""")
def pred_vs_actual_fit(t):
    out = metrics.fit_line(priced_lines(t), "y", "yhat")
    return out.select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"),
                      F.round("r2", 6).alias("r2"), F.round("rmse", 4).alias("rmse"), "n")


@query("residuals", f"SELECT l_orderkey, l_linenumber, round(yhat, 4) AS yhat, round(y - yhat, 4) AS residual FROM {REGRESSION}")
def residuals(t):
    return metrics.residuals(priced_lines(t), "y", "yhat").select(
        "l_orderkey", "l_linenumber", F.round("yhat", 4).alias("yhat"), F.round("residual", 4).alias("residual"))


@query("error_cost", f"SELECT round(avg(abs(y - yhat)), 4) AS mae, round(avg(abs(y - yhat)) * 120 * 1000, 0) AS expected_cost FROM {REGRESSION}")
def error_cost(t):
    return decisions.error_cost(priced_lines(t), "y", "yhat").select(
        F.round("mae", 4).alias("mae"), F.round("expected_cost", 0).alias("expected_cost"))


@query("error_histogram", f"""
WITH e AS (SELECT abs(y - yhat) AS e FROM {REGRESSION}), r AS (SELECT min(e) AS lo, (max(e) - min(e)) / 35 AS w FROM e),
h AS (SELECT cast(least(floor((e - lo) / w), 34) as int) AS bin, count(*) AS n FROM e, r GROUP BY 1)
SELECT g.bin::int AS bin, coalesce(n, 0)::bigint AS n FROM (SELECT unnest(range(35)) AS bin) g LEFT JOIN h ON h.bin = g.bin""")
def error_histogram(t):
    e = priced_lines(t).select(F.abs(F.col("y") - F.col("yhat")).alias("e"))
    return profile.histogram(e, "e", 35).select("bin", "n")


_SPLIT = sql_bucket("event_id", 42, 1_000_000) + " < 200000"


@query("overfit_gap", f"""
WITH x AS {SCORED_EVENTS}, a AS (SELECT event_type AS model, avg(cast(label = prediction as double)) FILTER (NOT ({_SPLIT})) AS tr,
  avg(cast(label = prediction as double)) FILTER ({_SPLIT}) AS te FROM x GROUP BY event_type)
SELECT model, round(tr, 6) AS train_score, round(te, 6) AS test_score, round(tr - te, 6) AS gap,
  CASE WHEN tr - te > 0.10 THEN 'HIGH' WHEN tr - te > 0.05 THEN 'MODERATE' ELSE 'GOOD' END AS overfit FROM a""")
def overfit_gap(t):
    """Accuracy per event type as the model name, on the training and the test events."""
    hit = (F.col("label") == F.col("prediction")).cast("double")
    test = F.col("is_test") == 1
    scores = splits.random_split(scored_events(t), "event_id").groupBy(F.col("event_type").alias("model")).agg(
        F.avg(F.when(~test, hit)).alias("train_score"), F.avg(F.when(test, hit)).alias("test_score"))
    out = metrics.overfit_gap(scores)
    return out.select("model", *[F.round(c, 6).alias(c) for c in ("train_score", "test_score", "gap")], "overfit")
