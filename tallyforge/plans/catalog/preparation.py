from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tallyforge.operators import features, imbalance, prepare, splits
from tallyforge.plans.catalog.base import (
    EVENTS_WITH_GAPS, LABELLED_DOCUMENTS, ORDERS_WITH_GAPS, events_with_gaps, labelled_documents,
    orders_with_gaps, query, sql_bucket,
)
from tallyforge.plans.catalog.profiling import ORDERS_ROLES, _NUMERIC

_TEST = sql_bucket("{k}", 42, 1_000_000) + " < 200000"


@query("impute_mean", f"""
WITH e AS {EVENTS_WITH_GAPS}
SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM e)), 4) AS value FROM e""")
def impute_mean(t):
    e = events_with_gaps(t).select("event_id", "value")
    return prepare.impute(e, ["value"]).withColumn("value", F.round("value", 4))


@query("impute_median", f"""
WITH e AS {EVENTS_WITH_GAPS}
SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM e)), 4) AS value FROM e""")
def impute_median(t):
    e = events_with_gaps(t).select("event_id", "value")
    return prepare.impute_robust(e, ["value"]).withColumn("value", F.round("value", 4))


@query("impute_mode", f"""
WITH o AS {ORDERS_WITH_GAPS},
p AS (SELECT o_orderpriority AS v FROM o WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
s AS (SELECT o_orderstatus AS v FROM o WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT o_orderkey, coalesce(o_orderpriority, (SELECT v FROM p)) AS o_orderpriority,
  coalesce(o_orderstatus, (SELECT v FROM s)) AS o_orderstatus FROM o""")
def impute_mode(t):
    o = orders_with_gaps(t).select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return prepare.impute(o, [], ["o_orderpriority", "o_orderstatus"])


@query("select_scaler", f"""
SELECT 'lineitem' AS "table", CASE WHEN greatest({', '.join(f'var_samp({c})' for c in _NUMERIC)}) > 1
  THEN 'standard' ELSE 'minmax' END AS scaler FROM lineitem
UNION ALL SELECT 'rates', CASE WHEN greatest(var_samp(l_discount), var_samp(l_tax)) > 1
  THEN 'standard' ELSE 'minmax' END FROM lineitem""")
def select_scaler(t):
    rows = [("lineitem", prepare.choose_scaler(t.lineitem, _NUMERIC)),
            ("rates", prepare.choose_scaler(t.lineitem, ["l_discount", "l_tax"]))]
    return t.spark.createDataFrame(rows, "table string, scaler string")


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _scaled(t, kind):
    df = t.lineitem.select("l_orderkey", "l_linenumber", *_MEASURES)
    return prepare.Scaler.fit(df, _MEASURES, kind).transform(df).withColumns(
        {c: F.round(c, 4) for c in _MEASURES})


@query("scale_standard", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 4) AS {c}" for c in _MEASURES) + " FROM lineitem")
def scale_standard(t):
    return _scaled(t, "standard")


@query("scale_minmax", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 4) AS {c}" for c in _MEASURES) + " FROM lineitem")
def scale_minmax(t):
    return _scaled(t, "minmax")




@query("encode_onehot", "SELECT c_custkey, v.value AS level, cast(c_mktsegment = v.value as double) AS flag "
       "FROM customer, (SELECT DISTINCT c_mktsegment AS value FROM customer) v")
def encode_onehot(t):
    found = prepare.levels(t.customer, ["c_mktsegment"])["c_mktsegment"]
    hot = prepare.one_hot("c_mktsegment", found)
    pairs = F.array(*[F.struct(F.lit(v).alias("level"), x.alias("flag")) for v, x in zip(found, hot)])
    return t.customer.select("c_custkey", F.inline(pairs))


@query("encode_ordinal", f"""
WITH tr AS (SELECT DISTINCT c_name AS v FROM customer WHERE NOT {_TEST.format(k='c_custkey')}),
m AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM tr)
SELECT c_custkey, coalesce(code, -1)::double AS code FROM customer LEFT JOIN m ON c_name = v""")
def encode_ordinal(t):
    """Codes fitted on the training customers; names seen only in the test rows get -1."""
    c = splits.random_split(t.customer, "c_custkey")
    return prepare.ordinal(c, "c_name", "code", fit_on=c.filter("is_test = 0")).select(
        "c_custkey", "code")


@query("drop_unusable", f"""
SELECT 'general' AS rule, "column" AS dropped FROM ({ORDERS_ROLES}) WHERE is_id = 1
UNION ALL SELECT 'churn', "column" FROM ({ORDERS_ROLES}) WHERE contains("column", 'id') OR contains("column", 'date')
  OR (dtype = 'string' AND nunique > 100)""")
def drop_unusable(t):
    general = prepare.usable_general(t.orders, "o_orderstatus").ids
    churn = prepare.usable_churn(t.orders, "o_orderstatus")[2]
    rows = [("general", c) for c in general] + [("churn", c) for c in churn]
    return t.spark.createDataFrame(rows, "rule string, dropped string")


def _feature_means(df, plan, group):
    """Mean of each feature per group of rows."""
    parts = vector_to_array("features")
    names = F.array(*[F.lit(n) for n in plan.names])
    pairs = F.arrays_zip(names.alias("feature"), parts.alias("x"))
    return (
        df.select(group, F.inline(pairs).alias("feature", "x")).groupBy(group, "feature")
        .agg(F.round(F.avg("x"), 4).alias("mean"), F.count("x").alias("n"))
    )


def _prepared_sql(rows: str, middle: str, scale: str, kept: str = "true") -> str:
    return f"""
WITH d AS {LABELLED_DOCUMENTS}, s AS (SELECT *, {rows} AS is_test FROM d),
f AS (SELECT {middle} AS m, {scale} AS w FROM s WHERE is_test = 0),
v AS (SELECT DISTINCT 'lang' AS c, lang AS v FROM s WHERE is_test = 0 UNION ALL SELECT DISTINCT 'source', source FROM s WHERE is_test = 0)
SELECT is_test, 'n_chars' AS feature, round(avg((n_chars - m) / w), 4) AS mean, count(*) AS n FROM s, f WHERE {kept} GROUP BY is_test
UNION ALL SELECT is_test, c || '_' || v, round(avg(cast(CASE c WHEN 'lang' THEN lang ELSE source END = v as double)), 4), count(*)
FROM s, v GROUP BY is_test, c, v"""


# the length is left out as an id where nearly all of its values differ
_LENGTH_KEPT = """(SELECT count(DISTINCT n_chars) < count(*) AND (count(*) <= 50 OR count(DISTINCT n_chars) / count(*)::double <= 0.95) FROM d)"""


@query("prep_general", _prepared_sql(f"cast({_TEST.format(k='doc_id')} as int)", "avg(n_chars)", "stddev_pop(n_chars)", _LENGTH_KEPT))
def prep_general(t):
    df = splits.random_split(labelled_documents(t), "doc_id")
    use = prepare.usable_general(df.drop("is_test"), "quality", "doc_id")
    train = df.filter("is_test = 0")
    test = splits.drop_unseen(train, df.filter("is_test = 1"), use.low_card + use.high_card)
    numeric = [c for c in use.numeric]
    plan = prepare.fit_plan(train, numeric, use.low_card, use.high_card, use.ids)
    return _feature_means(plan.transform(train.unionByName(test.select(train.columns))), plan, "is_test")


_STRATIFIED = f"""cast(row_number() OVER (PARTITION BY {{y}} ORDER BY {sql_bucket('{k}', 42, 2 ** 32)}, {{k}})
  <= floor(count(*) OVER (PARTITION BY {{y}}) * 0.2::double + 0.5) as int)"""


@query("prep_churn", _prepared_sql(_STRATIFIED.format(y="quality", k="doc_id"), "avg(n_chars)", "stddev_pop(n_chars)"))
def prep_churn(t):
    df = splits.stratified_split(labelled_documents(t), "doc_id", "quality")
    numeric, strings, dropped = prepare.usable_churn(df.drop("is_test"), "quality", "doc_id")
    plan = prepare.fit_plan(df.filter("is_test = 0"), numeric, strings, dropped=dropped,
                            center="median", scaler="standard")
    return _feature_means(plan.transform(df), plan, "is_test")


@query("prep_cluster", """
WITH s AS (SELECT *, (SELECT avg(c_acctbal) FROM customer) AS ma, (SELECT stddev_pop(c_acctbal) FROM customer) AS sa FROM customer)
SELECT c_mktsegment AS "group", 'c_acctbal' AS feature, round(avg((c_acctbal - ma) / sa), 4) AS mean, count(*) AS n FROM s GROUP BY 1
UNION ALL SELECT a.c_mktsegment, 'c_mktsegment_' || v, cast(a.c_mktsegment = v as double), count(*)
FROM customer a, (SELECT DISTINCT c_mktsegment AS v FROM customer) GROUP BY a.c_mktsegment, v""")
def prep_cluster(t):
    c = t.customer.select("c_acctbal", "c_mktsegment", F.col("c_mktsegment").alias("group"))
    plan = prepare.clustering_plan(c, exclude=["group"])
    return _feature_means(plan.transform(c), plan, "group")


@query("split_random", f"SELECT o_orderkey, cast({_TEST.format(k='o_orderkey')} as int) AS is_test FROM orders")
def split_random(t):
    return splits.random_split(t.orders.select("o_orderkey"), "o_orderkey")


@query("split_stratified", f"SELECT doc_id, quality, {_STRATIFIED.format(y='quality', k='doc_id')} AS is_test FROM labels")
def split_stratified(t):
    return splits.stratified_split(t.labels.select("doc_id", "quality"), "doc_id", "quality")


@query("drop_unseen_rows", f"""
SELECT p_partkey FROM part WHERE {_TEST.format(k='p_partkey')}
  AND p_name IN (SELECT p_name FROM part WHERE NOT {_TEST.format(k='p_partkey')})
  AND concat(p_brand, '/', p_size) IN (SELECT concat(p_brand, '/', p_size) FROM part WHERE NOT {_TEST.format(k='p_partkey')})""")
def drop_unseen_rows(t):
    p = splits.random_split(t.part, "p_partkey").withColumn(
        "model", F.concat_ws("/", "p_brand", "p_size"))
    return splits.drop_unseen(p.filter("is_test = 0"), p.filter("is_test = 1"),
                              ["p_name", "model"]).select("p_partkey")


def _judge_sql(c: str) -> str:
    return (f"SELECT '{c}' AS c, count(DISTINCT {c}) AS u, count({c}) AS n, var_pop({c}) AS v, "
            f"(SELECT max(k) FROM (SELECT count(*) AS k FROM lineitem GROUP BY {c})) AS top FROM lineitem")


@query("select_numeric_features", f"""
WITH f AS ({' UNION ALL '.join(_judge_sql(c) for c in _NUMERIC)}),
s AS (SELECT *, CASE WHEN u / n::double > 0.995 AND u > least(100, greatest(20, n // 5)) THEN 'id_like'
   WHEN u <= 1 THEN 'constant' WHEN top / n::double >= 0.995 THEN 'near_constant' ELSE 'kept' END AS status FROM f)
SELECT c AS "column", status, round(v, 2) AS variance,
  CASE WHEN status = 'kept' THEN (row_number() OVER (PARTITION BY status ORDER BY v DESC) - 1)::int ELSE -1 END AS rank FROM s""")
def select_numeric_features(t):
    return features.judgement_table(t.lineitem).withColumn("variance", F.round("variance", 2))


@query("feat_row_stats", """
SELECT l_orderkey, l_linenumber, round((q + p + d + x) / 4, 4) AS row_mean,
  round(sqrt(((q - m) ** 2 + (p - m) ** 2 + (d - m) ** 2 + (x - m) ** 2) / 4), 4) AS row_std,
  round(least(q, p, d, x), 4) AS row_min, round(greatest(q, p, d, x), 4) AS row_max,
  round((abs(q) + abs(p) + abs(d) + abs(x)) / 4, 4) AS row_abs_mean,
  round(sqrt(q * q + p * p + d * d + x * x), 4) AS row_l2_norm
FROM (SELECT *, (q + p + d + x) / 4 AS m FROM (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_extendedprice AS p, l_discount AS d, l_tax AS x FROM lineitem))""")
def feat_row_stats(t):
    stats = features.row_statistics(_MEASURES)
    return t.lineitem.select("l_orderkey", "l_linenumber",
                             *[F.round(x, 4).alias(n) for n, x in stats.items()])


@query("feat_timeseries", """
SELECT event_id, round(value, 4) AS value, round(lag(value) OVER w, 4) AS value_lag1,
  round(value - lag(value) OVER w, 4) AS value_diff1,
  CASE WHEN count(value) OVER r >= 2 THEN round(avg(value) OVER r, 6) END AS value_roll_mean,
  round(stddev_samp(value) OVER r, 4) AS value_roll_std,
  round(date_diff('microsecond', lag(ts) OVER w, ts) / 1e6, 6) AS time_delta_seconds
FROM events WINDOW w AS (ORDER BY ts, event_id), r AS (ORDER BY ts, event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def feat_timeseries(t):
    out, names = features.timeseries_features(t.events, "ts", "event_id", ["value"])
    digits = {"time_delta_seconds": 6, "value_roll_mean": 6}
    return out.select("event_id", *[F.round(n, digits.get(n, 4)).alias(n) for n in names])


@query("cap_by_variance", f"""
SELECT c AS "column", (row_number() OVER (ORDER BY v DESC) - 1)::int AS rank FROM (
  {' UNION ALL '.join(f"SELECT '{c}' AS c, var_samp({c}) AS v FROM lineitem" for c in _NUMERIC)}) ORDER BY v DESC LIMIT 3""")
def cap_by_variance(t):
    kept = features.widest(t.lineitem, _NUMERIC, 3)
    return t.spark.createDataFrame(list(enumerate(kept)), "rank int, column string")


@query("project_pca")
def project_pca(t):
    from pyspark.ml.functions import array_to_vector

    e = t.embeddings.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    out, shares = features.project(e, k=3)
    ratio = F.array(*[F.lit(round(s, 6)) for s in shares])
    return out.select("vec_id", *[F.round(f"component_{i}", 6).alias(f"component_{i}") for i in (1, 2, 3)],
                      F.round(ratio[0] + ratio[1] + ratio[2], 6).alias("explained"))


@query("validate_matrix", """
WITH e AS (SELECT CASE WHEN vec_id % 50 = 0 THEN NULL WHEN vec_id % 50 = 1 THEN embedding[1:10]
   WHEN vec_id % 50 = 2 THEN list_concat(embedding[1:63], ['nan'::float]) WHEN vec_id % 50 = 3 THEN list_concat(embedding[1:63], ['inf'::float])
   ELSE embedding END AS x FROM embeddings),
c AS (SELECT count_if(x IS NULL) AS a, count_if(x IS NOT NULL AND len(x) <> 64) AS b, count_if(list_contains(x, 'nan'::float)) AS d,
  count_if(list_contains(x, 'inf'::float)) AS f FROM e)
SELECT rule, violations::bigint AS violations, cast(violations = 0 as int) AS passed FROM (
  SELECT 'null_rows' AS rule, a AS violations FROM c UNION ALL SELECT 'wrong_width', b FROM c UNION ALL SELECT 'null_values', 0 FROM c
  UNION ALL SELECT 'nan_values', d FROM c UNION ALL SELECT 'infinite_values', f FROM c UNION ALL SELECT 'no_rows', 0 FROM c)""")
def validate_matrix(t):
    """All embeddings, with faults planted by rule."""
    x, kind = F.col("embedding"), F.col("vec_id") % 50
    ending = lambda v: F.concat(F.slice(x, 1, 63), F.array(F.lit(v).cast("float")))
    faulty = (
        F.when(kind == 0, F.lit(None).cast("array<float>")).when(kind == 1, F.slice(x, 1, 10))
        .when(kind == 2, ending(float("nan"))).when(kind == 3, ending(float("inf"))).otherwise(x))
    return prepare.matrix_problems(t.embeddings.select(faulty.alias("x")), "x", 64)


@query("validate_target", """
SELECT 'quality' AS target, 'target_present' AS rule, count_if(quality IS NULL)::bigint AS violations, cast(count_if(quality IS NULL) = 0 as int) AS passed FROM labels
UNION ALL SELECT 'quality', 'two_classes', 0, cast(count(DISTINCT quality) >= 2 as int) FROM labels
UNION ALL SELECT 'o_totalprice', 'target_present', count_if(o_totalprice IS NULL)::bigint, cast(count_if(o_totalprice IS NULL) = 0 as int) FROM orders
UNION ALL SELECT 'o_totalprice', 'finite', count_if(NOT isfinite(o_totalprice))::bigint, cast(count_if(NOT isfinite(o_totalprice)) = 0 as int) FROM orders""")
def validate_target(t):
    a = prepare.target_problems(t.labels, "quality", "classification")
    b = prepare.target_problems(t.orders, "o_totalprice", "regression")
    return a.select(F.lit("quality").alias("target"), "*").unionByName(
        b.select(F.lit("o_totalprice").alias("target"), "*"))


@query("drop_null_target", f"SELECT o_orderkey, o_orderpriority FROM {ORDERS_WITH_GAPS} WHERE o_orderpriority IS NOT NULL")
def drop_null_target(t):
    return prepare.drop_null_target(orders_with_gaps(t), "o_orderpriority").select(
        "o_orderkey", "o_orderpriority")


@query("hash_folds", f"""
SELECT doc_id, quality, (SELECT 0) + """ + " + ".join(
    f"""cast(row_number() OVER (PARTITION BY quality ORDER BY {sql_bucket('doc_id', 42, 2 ** 32)}, doc_id)
      > floor(count(*) OVER (PARTITION BY quality) * {i}::double / 5 + 0.5) as int)""" for i in range(1, 5)) + " AS fold FROM labels")
def hash_folds(t):
    return splits.folds(t.labels.select("doc_id", "quality"), "doc_id", 5, "quality")


# -- imbalance ---------------------------------------------------------------------------------

@query("imb_diagnose", """
SELECT n AS total, p AS positive, n - p AS negative, round(p * 100.0::double / n, 4) AS rate_pct,
  round(p / greatest(n - p, 1)::double, 6) AS ratio,
  CASE WHEN p / greatest(n - p, 1)::double < 0.15 THEN 'severe' WHEN p / greatest(n - p, 1)::double < 0.30 THEN 'moderate' ELSE 'acceptable' END AS imbalance
FROM (SELECT count(*) AS n, sum(toxic)::bigint AS p FROM labels)""")
def imb_diagnose(t):
    return imbalance.diagnose(t.labels, "toxic")


@query("imb_class_weight", """
SELECT toxic, round(n / (k * c)::double, 6) AS weight FROM (SELECT toxic, count(*) AS c, sum(count(*)) OVER () AS n,
  count(*) OVER () AS k FROM labels GROUP BY toxic)""")
def imb_class_weight(t):
    weights = imbalance.balanced_weights(t.labels, "toxic")
    w = imbalance.weight_column(weights, "toxic")
    return t.labels.groupBy("toxic").agg(F.round(F.avg(w), 6).alias("weight"))


@query("imb_undersample", f"""
SELECT doc_id, toxic FROM labels QUALIFY row_number() OVER (PARTITION BY toxic ORDER BY {sql_bucket('doc_id', 42, 2 ** 32)}, doc_id)
  <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY toxic))""")
def imb_undersample(t):
    return imbalance.undersample(t.labels.select("doc_id", "toxic"), "doc_id", "toxic")
