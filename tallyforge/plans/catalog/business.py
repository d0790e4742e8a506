from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tallyforge.operators import anomaly, drift, drivers, recommend, segments
from tallyforge.plans.catalog.base import LABELLED_DOCUMENTS, SCORED_EVENTS, query, scored_events
from tallyforge.plans.catalog.profiling import _NUMERIC
from tallyforge.session import materialise

# -- recommendation: who bought which part -------------------------------------------------------

_BASKET = """u AS (SELECT DISTINCT o_custkey::varchar AS "user", l_partkey::varchar AS item FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
b AS (SELECT "user", item FROM u),
n AS (SELECT item, count(*) AS users FROM b GROUP BY item)"""
_PAIRS = _BASKET + """, s AS (SELECT x.item AS a, y.item AS b, count(*) AS support FROM b x JOIN b y ON x."user" = y."user" AND x.item < y.item GROUP BY ALL HAVING count(*) >= 2),
p AS (SELECT s.a AS item, s.b AS neighbour, support, support / users::double AS confidence FROM s JOIN n ON n.item = s.a
  UNION ALL SELECT s.b, s.a, support, support / users::double FROM s JOIN n ON n.item = s.b)"""


def purchases(t):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("customer"), F.col("l_partkey").alias("part"))


def _basket(t):
    return recommend.baskets(purchases(t), "customer", "part")


@query("item_basket", f'WITH {_BASKET} SELECT "user", item FROM b')
def item_basket(t):
    return _basket(t)


@query("item_counts", f"WITH {_BASKET} SELECT item, users FROM n")
def item_counts(t):
    return recommend.item_counts(_basket(t))


@query("item_cooccurrence", f"WITH {_PAIRS} SELECT item, neighbour, support, round(confidence, 6) AS confidence FROM p")
def item_cooccurrence(t):
    return recommend.cooccurrence(materialise(_basket(t))).withColumn("confidence", F.round("confidence", 6))


@query("item_top_n", f"""WITH {_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY support DESC, confidence DESC, neighbour)::int AS rank FROM p)
SELECT item, neighbour, support, round(confidence, 6) AS confidence, rank FROM r WHERE rank <= 10""")
def item_top_n(t):
    best = recommend.top_neighbours(recommend.cooccurrence(materialise(_basket(t))))
    return best.withColumn("confidence", F.round("confidence", 6))


@query("reco_summary", f"""WITH {_PAIRS} SELECT 'interactions' AS measure, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey
UNION ALL SELECT 'items', count(*) FROM n UNION ALL SELECT 'items_with_neighbours', count(DISTINCT item) FROM p""")
def reco_summary(t):
    bought, basket = purchases(t), materialise(_basket(t))
    return recommend.summary(bought, "customer", "part", basket, recommend.cooccurrence(basket))


@query("rank_by_score", f"""SELECT event_id, user_id, label, score, cast(score >= 0.5 as int) AS predicted FROM {SCORED_EVENTS}
ORDER BY score DESC, event_id LIMIT 50""")
def rank_by_score(t):
    e = scored_events(t).select("event_id", "user_id", "label", "score")
    return recommend.rank_by_score(e, "score", "event_id", "label", 50)


# -- drift: early against late rows --------------------------------------------------------------

_DRIFT_COLUMNS = {"lineitem": _NUMERIC, "events": ["event_id", "user_id", "value"]}
_CUT = {"lineitem": ("l_shipdate", "1998-01-01"), "events": ("ts", "2024-01-16")}


def _halves(t, table):
    column, date = _CUT[table]
    early = F.col(column) < F.lit(date).cast("timestamp_ntz")
    df = getattr(t, table)
    return df.filter(early), df.filter(~early)


def _drift_sql(table: str) -> str:
    column, date = _CUT[table]
    long = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c}::double AS x, {column} < TIMESTAMP '{date}' AS r FROM {table}" for c in _DRIFT_COLUMNS[table])
    return f"""v AS ({long}), t AS (SELECT feature, min(x) AS lo, (max(x) - min(x)) / 10 AS w, count_if(r)::double AS n, count_if(NOT r)::double AS m FROM v GROUP BY feature),
g AS (SELECT feature, b FROM t, (SELECT unnest(range(10)) AS b)),
h AS (SELECT feature, {' + '.join(f'cast(x >= lo + w * {i} as int)' for i in range(1, 10))} AS b, count_if(r) AS c, count_if(NOT r) AS a FROM v JOIN t USING (feature) GROUP BY ALL),
sh AS (SELECT feature, (coalesce(c, 0) + 1e-8::double) / (n + 1e-7::double) AS e, (coalesce(a, 0) + 1e-8::double) / (m + 1e-7::double) AS a FROM g JOIN t USING (feature) LEFT JOIN h USING (feature, b)),
psi AS (SELECT feature, round(abs(sum((a - e) * ln(a / e))), 6) AS psi FROM sh GROUP BY feature),
c AS (SELECT feature, x, count_if(r) AS c, count_if(NOT r) AS a FROM v GROUP BY ALL),
f AS (SELECT feature, sum(c) OVER w / n - sum(a) OVER w / m AS gap FROM c JOIN t USING (feature) WINDOW w AS (PARTITION BY feature ORDER BY x)),
d AS (SELECT feature, max(abs(gap)) AS d, any_value(n) AS n, any_value(m) AS m FROM f JOIN t USING (feature) GROUP BY feature),
l AS (SELECT feature, d, n, m, (sqrt(n * m / (n + m)) + 0.12::double + 0.11::double / sqrt(n * m / (n + m))) * d AS lam FROM d),
q AS (SELECT feature, any_value(d) AS d, any_value(n)::bigint AS n_ref, any_value(m)::bigint AS n_cur,
  CASE WHEN any_value(lam) < 1e-3 THEN 1.0::double ELSE greatest(0.0::double, least(1.0::double, sum(CASE WHEN j % 2 = 1 THEN 2.0::double ELSE -2.0::double END * exp(-2.0::double * j * j * lam * lam)))) END AS p
  FROM l, (SELECT unnest(range(1, 101)) AS j) GROUP BY feature)"""


_LEVEL = "CASE WHEN psi > 0.2 OR round(d, 6) > 0.3 THEN 'Major' WHEN psi > 0.1 OR round(d, 6) > 0.15 THEN 'Minor' ELSE 'Stable' END"


@query("drift_psi", f"WITH {_drift_sql('lineitem')} SELECT feature, psi FROM psi")
def drift_psi(t):
    return drift.psi(drift.paired_counts(*_halves(t, "lineitem")))


@query("drift_ks", f"WITH {_drift_sql('lineitem')} SELECT feature, round(d, 6) AS ks_stat, round(p, 6) AS p_value, n_ref, n_cur FROM q")
def drift_ks(t):
    return drift.ks(drift.paired_counts(*_halves(t, "lineitem")))


@query("drift_report", f"""WITH {_drift_sql('events')} SELECT feature, round(round(d, 6), 4) AS ks_stat, round(round(p, 6), 4) AS p_value, psi, {_LEVEL} AS level FROM q JOIN psi USING (feature)""")
def drift_report(t):
    return drift.drift_report(*_halves(t, "events"))


@query("drift_levels", f"""WITH {_drift_sql('events')}, r AS (SELECT feature, {_LEVEL} AS level FROM q JOIN psi USING (feature))
SELECT level, count(*) AS n, string_agg(feature, ', ' ORDER BY feature) AS features FROM r GROUP BY level""")
def drift_levels(t):
    return drift.drift_levels(drift_report(t))


# -- drivers -------------------------------------------------------------------------------------

def _documents(t):
    return t.documents.join(t.labels, "doc_id").select("n_chars", "lang", "source", "toxic")


@query("churn_overview", """SELECT count(*) AS total, sum(toxic)::bigint AS churned, (count(*) - sum(toxic))::bigint AS retained,
  round(sum(toxic) * 100.0::double / count(*), 4) AS churn_rate_pct FROM labels""")
def churn_overview(t):
    return drivers.churn_overview(t.labels, "toxic")


@query("churn_by_category", f"""WITH d AS {LABELLED_DOCUMENTS}, x AS (SELECT 'lang' AS "column", lang AS level, toxic FROM d UNION ALL SELECT 'source', source, toxic FROM d)
SELECT "column", level, count(*) AS n, sum(toxic)::bigint AS churned, round(sum(toxic) * 100.0::double / count(*), 4) AS churn_pct FROM x GROUP BY ALL HAVING sum(toxic) > 0""")
def churn_by_category(t):
    return drivers.churn_by_category(_documents(t), "toxic")


@query("churn_correlations", f"""WITH d AS {LABELLED_DOCUMENTS}, x AS (SELECT n_chars, dense_rank() OVER (ORDER BY lang) AS l, dense_rank() OVER (ORDER BY source) AS s, toxic AS y FROM d),
c AS (SELECT 'n_chars' AS feature, corr(n_chars, y) AS r FROM x UNION ALL SELECT 'lang', corr(l, y) FROM x UNION ALL SELECT 'source', corr(s, y) FROM x)
SELECT feature, round(r, 6) AS correlation, round(abs(r), 6) AS strength FROM c""")
def churn_correlations(t):
    return drivers.churn_correlations(_documents(t), "toxic")


@query("top_correlations", "WITH c AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS r FROM lineitem" for c in _NUMERIC if c != "l_extendedprice")
    + ") SELECT feature, round(r, 6) AS correlation, round(abs(r), 6) AS strength FROM c ORDER BY strength DESC LIMIT 10")
def top_correlations(t):
    return drivers.top_correlations(t.lineitem, "l_extendedprice")


# -- segments ------------------------------------------------------------------------------------

def vectors(t):
    return t.embeddings.select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


_DIMS = """v AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS d, unnest(embedding)::double AS x FROM embeddings),
m AS (SELECT label, d, avg(x) AS mu, count(*) AS n FROM v GROUP BY label, d)"""


@query("m_davies_bouldin", f"""WITH {_DIMS}, s AS (SELECT label, avg(dist) AS s FROM (SELECT v.label, vec_id, sqrt(sum((x - mu) ** 2)) AS dist FROM v JOIN m ON v.label = m.label AND v.d = m.d GROUP BY v.label, vec_id) GROUP BY label),
g AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.mu - b.mu) ** 2)) AS gap FROM m a JOIN m b ON a.d = b.d AND a.label <> b.label GROUP BY ALL)
SELECT round(avg(w), 6) AS davies_bouldin FROM (SELECT i, max((x.s + y.s) / gap) AS w FROM g JOIN s x ON x.label = i JOIN s y ON y.label = j GROUP BY i)""")
def m_davies_bouldin(t):
    value = segments.davies_bouldin(vectors(t), "label")
    return t.spark.createDataFrame([(round(value, 6),)], "davies_bouldin double")


@query("m_calinski_harabasz", f"""WITH {_DIMS}, g AS (SELECT d, avg(x) AS mu FROM v GROUP BY d),
b AS (SELECT sum(m.n * (m.mu - g.mu) ** 2) AS b, count(DISTINCT label) AS k FROM m JOIN g USING (d)),
w AS (SELECT sum((x - mu) ** 2) AS w, count(DISTINCT vec_id) AS n FROM v JOIN m ON v.label = m.label AND v.d = m.d)
SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM b, w""")
def m_calinski_harabasz(t):
    value = segments.calinski_harabasz(vectors(t), "label")
    return t.spark.createDataFrame([(round(value, 6),)], "calinski_harabasz double")


@query("cluster_distribution", """SELECT label AS cluster, 'Cluster ' || label AS name, count(*) AS n,
  round(count(*) * 100.0::double / sum(count(*)) OVER (), 2) AS share_pct FROM embeddings GROUP BY label""")
def cluster_distribution(t):
    return segments.distribution(t.embeddings, "label")


@query("segment_profile", """SELECT c_mktsegment AS segment, count(*) AS segment_size, round(count(*) * 100.0::double / sum(count(*)) OVER (), 2) AS segment_share_pct,
  round(avg(c_acctbal), 3) AS c_acctbal, round(avg(c_nationkey), 3) AS c_nationkey FROM customer GROUP BY 1""")
def segment_profile(t):
    return segments.profile(t.customer, "c_mktsegment", ["c_acctbal", "c_nationkey"])


@query("segment_action", """WITH c AS (SELECT c_mktsegment AS segment, count(*) AS records FROM customer GROUP BY 1),
s AS (SELECT *, round(records * 100.0::double / sum(records) OVER (), 2) AS share_pct, round(100.0::double * max(records) OVER () / sum(records) OVER (), 2) AS largest_share_pct, count(*) OVER () AS segments FROM c)
SELECT segment, records, share_pct, CASE WHEN share_pct >= 30 THEN 'Create dedicated playbook' ELSE 'Include in targeted cohort' END AS recommended_action, largest_share_pct, segments FROM s""")
def segment_action(t):
    return segments.actions(t.customer, "c_mktsegment")


# -- anomaly tables, with the event value as the score ---------------------------------------------

_FLAGGED = "(SELECT event_id, ts, value, cast(value > (SELECT quantile_cont(value, 0.95) FROM events) as int) AS is_anomaly FROM events)"


def flagged(t):
    return anomaly.label_by_share(t.events.select("event_id", "ts", "value"), "value")


@query("anomaly_label", f"SELECT event_id, value, is_anomaly FROM {_FLAGGED}")
def anomaly_label(t):
    return flagged(t).select("event_id", "value", "is_anomaly")


@query("anomaly_summary", f"""SELECT count(*) AS total, sum(is_anomaly)::bigint AS anomalies, (count(*) - sum(is_anomaly))::bigint AS normal,
  round(sum(is_anomaly) * 100.0::double / count(*), 4) AS anomaly_pct FROM {_FLAGGED}""")
def anomaly_summary(t):
    return anomaly.summary(flagged(t))


@query("anomaly_top", f"SELECT * FROM {_FLAGGED} ORDER BY value DESC, event_id LIMIT 200")
def anomaly_top(t):
    return anomaly.top(flagged(t), "value", "event_id")


@query("anomaly_timeline", f"SELECT ts, value, value AS score, is_anomaly, CASE WHEN is_anomaly = 1 THEN value END AS anomaly_value FROM {_FLAGGED}")
def anomaly_timeline(t):
    return anomaly.timeline(flagged(t).withColumn("score", F.col("value")), "ts", "value", "score")


_LINE_FLAG = "(SELECT *, cast(l_extendedprice > (SELECT quantile_cont(l_extendedprice, 0.95) FROM lineitem) as int) AS is_anomaly FROM lineitem)"


@query("anomaly_importance", f"WITH x AS {_LINE_FLAG} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(abs(median({c}) FILTER (is_anomaly = 1) - median({c}) FILTER (is_anomaly = 0)) / (abs(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) + 1e-9), 6) AS importance FROM x"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def anomaly_importance(t):
    df = anomaly.label_by_share(t.lineitem, "l_extendedprice")
    return anomaly.importance(df, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).withColumn(
        "importance", F.round("importance", 6))
