from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.operators import density, imbalance, nearest, silhouette, splits
from tallyforge.operators.prepare import Scaler
from tallyforge.plans.catalog.base import query, sql_bucket

_TEST = sql_bucket("{k}", 42, 1_000_000) + " < 200000"


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("key"), "label", F.col("embedding").cast("array<double>").alias("features"))


_V = "v AS (SELECT vec_id AS k, label, embedding::double[] AS x FROM embeddings)"
_L2 = "list_distance({a}, {b})"


@query("nearest_rows", f"""WITH {_V}, d AS (SELECT a.k AS query, b.k AS neighbour, {_L2.format(a='a.x', b='b.x')} AS dist FROM v a JOIN v b ON a.k <> b.k)
SELECT query, neighbour, round(dist, 6) AS distance, rank::int AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY dist, neighbour) AS rank FROM d) WHERE rank <= 5""")
def nearest_rows(t):
    return nearest.nearest(_vectors(t), 5).withColumn("distance", F.round("distance", 6))


@query("cls_knn", f"""WITH {_V}, te AS (SELECT * FROM v WHERE {_TEST.format(k='k')}), tr AS (SELECT * FROM v WHERE NOT {_TEST.format(k='k')}),
n AS (SELECT q, label FROM (SELECT te.k AS q, tr.label, row_number() OVER (PARTITION BY te.k ORDER BY {_L2.format(a='te.x', b='tr.x')}, tr.k) AS r FROM te, tr) WHERE r <= 5),
w AS (SELECT q, label, count(*) AS c, sum(count(*)) OVER (PARTITION BY q) AS a FROM n GROUP BY q, label)
SELECT q AS "key", label AS prediction, round(c / a::double, 6) AS confidence FROM w QUALIFY row_number() OVER (PARTITION BY q ORDER BY c DESC, label) = 1""")
def cls_knn(t):
    v = splits.random_split(_vectors(t), "key")
    out = density.neighbour_vote(v.filter("is_test = 0"), v.filter("is_test = 1"), "label", 5)
    return out.withColumn("confidence", F.round("confidence", 6))


@query("reg_knn", f"""WITH p AS (SELECT p_partkey AS k, p_size::double AS x, p_retailprice AS y FROM part), te AS (SELECT * FROM p WHERE {_TEST.format(k='k')}), tr AS (SELECT * FROM p WHERE NOT {_TEST.format(k='k')}),
n AS (SELECT q, y FROM (SELECT te.k AS q, tr.y, row_number() OVER (PARTITION BY te.k ORDER BY abs(te.x - tr.x), tr.k) AS r FROM te, tr) WHERE r <= 5)
SELECT q AS "key", round(avg(y), 4) AS prediction FROM n GROUP BY q""")
def reg_knn(t):
    p = t.part.select(F.col("p_partkey").alias("key"), F.array(F.col("p_size").cast("double")).alias("features"), F.col("p_retailprice").alias("y"))
    p = splits.random_split(p, "key")
    out = density.neighbour_mean(p.filter("is_test = 0"), p.filter("is_test = 1"), "y", 5)
    return out.withColumn("prediction", F.round("prediction", 4))


def customers(t):
    """All customers as points: scaled balance and nation."""
    c = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("a"), F.col("c_nationkey").cast("double").alias("b"))
    scaled = Scaler.fit(c, ["a", "b"]).transform(c)
    return scaled.select("key", F.array(F.round("a", 6), F.round("b", 6)).alias("features"))


_CUSTOMERS = """c AS (SELECT c_custkey AS k, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS a,
  round((c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER (), 6) AS b FROM customer)"""


@query("lof_score", f"""WITH {_CUSTOMERS}, kk AS (SELECT least(greatest(6, least(35, count(*) // 20)), greatest(2, count(*) - 1)) AS k FROM c),
n AS (SELECT * FROM (SELECT x.k AS q, y.k AS o, sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) AS d,
  row_number() OVER (PARTITION BY x.k ORDER BY sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)), y.k) AS r FROM c x JOIN c y ON x.k <> y.k) WHERE r <= (SELECT k FROM kk)),
h AS (SELECT q, max(d) AS kd FROM n GROUP BY q),
l AS (SELECT n.q, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM n JOIN h ON h.q = n.o GROUP BY n.q)
SELECT n.q AS "key", round(avg(o.lrd) / any_value(m.lrd), 4) AS lof FROM n JOIN l o ON o.q = n.o JOIN l m ON m.q = n.q GROUP BY n.q""")
def lof_score(t):
    return density.local_outlier_factor(customers(t)).withColumn("lof", F.round("lof", 4))


_EPS, _MIN = 0.06, 5


@query("clu_dbscan", f"""WITH RECURSIVE {_CUSTOMERS},
e AS (SELECT x.k AS p, y.k AS q FROM c x, c y WHERE sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)) <= {_EPS}),
core AS (SELECT p FROM e GROUP BY p HAVING count(*) >= {_MIN}),
g AS (SELECT e.p, e.q FROM e JOIN core a ON a.p = e.p JOIN core b ON b.p = e.q),
r(p, root) AS (SELECT p, p FROM core UNION SELECT g.q, r.root FROM r JOIN g ON g.p = r.p WHERE r.root < g.q),
m AS (SELECT p, min(root) AS root FROM r GROUP BY p),
b AS (SELECT e.p, min(m.root) AS root FROM e JOIN m ON m.p = e.q WHERE e.p NOT IN (SELECT p FROM core) GROUP BY e.p),
n AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM m)),
a AS (SELECT p, root, 1 AS is_core FROM m UNION ALL SELECT p, root, 0 FROM b)
SELECT c.k AS "key", coalesce(n.cluster, -1)::bigint AS cluster, coalesce(is_core, 0)::int AS is_core FROM c LEFT JOIN a ON a.p = c.k LEFT JOIN n ON n.root = a.root""")
def clu_dbscan(t):
    return density.dbscan(customers(t), eps=_EPS, min_samples=_MIN)


# mean squared distances of every pair of rows
_SIL = f"""{_V}, d AS (SELECT p.k, p.label AS mine, q.label AS theirs, sum({_L2.format(a='p.x', b='q.x')} ** 2) AS s, count(*) AS n FROM v p JOIN v q ON p.k <> q.k GROUP BY ALL),
ab AS (SELECT k, mine, max(s / n) FILTER (mine = theirs) AS a, min(s / n) FILTER (mine <> theirs) AS b FROM d GROUP BY k, mine),
s AS (SELECT k, mine, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS silhouette FROM ab)"""


@query("silhouette_samples", f'WITH {_SIL} SELECT k AS "key", mine AS label, round(silhouette, 6) AS silhouette FROM s')
def silhouette_samples(t):
    out = silhouette.silhouette_samples(_vectors(t), "label")
    return out.select("key", "label", F.round("silhouette", 6).alias("silhouette"))


@query("m_silhouette", f"WITH {_SIL} SELECT round(avg(silhouette), 6) AS silhouette FROM s")
def m_silhouette(t):
    value = silhouette.silhouette(_vectors(t), "label")
    return t.spark.createDataFrame([(round(value, 6),)], "silhouette double")


@query("m_silhouette_squared", f"WITH {_SIL} SELECT round(avg(silhouette), 6) AS silhouette FROM s")
def m_silhouette_squared(t):
    value = silhouette.silhouette(_vectors(t), "label")
    return t.spark.createDataFrame([(round(value, 6),)], "silhouette double")


def _toxic_points(t):
    """All labelled documents as points: scaled length, language and source code."""
    from tallyforge.operators.prepare import fit_plan
    from tallyforge.plans.catalog.base import labelled_documents
    from pyspark.ml.functions import vector_to_array

    d = labelled_documents(t, "toxic")
    plan = fit_plan(d, ["n_chars"], ["lang"], scaler="standard")
    return plan.transform(d).select(F.col("doc_id").alias("key"), F.col("toxic").alias("label"), vector_to_array("features").alias("features"))


def _class_sizes(df):
    return df.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.col("features")[0]), 6).alias("mean_length"))


@query("imb_smote", """WITH c AS (SELECT toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY toxic)
SELECT toxic AS label, (SELECT max(n) FROM c) AS n FROM c""")
def imb_smote(t):
    d = _toxic_points(t)
    return _class_sizes(imbalance.resample(d, imbalance.smote(d))).select("label", "n")


@query("imb_adasyn")
def imb_adasyn(t):
    d = _toxic_points(t)
    return _class_sizes(imbalance.resample(d, imbalance.adasyn(d)))
