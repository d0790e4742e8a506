from __future__ import annotations

from tallyforge.functions import vocab
from tallyforge.operators import profile, roles
from tallyforge.plans.catalog.base import EVENTS_WITH_GAPS, events_with_gaps, query, union_all

DOCUMENT_COLUMNS = ("text", "lang", "source")


@query("prof_overview", """
WITH d AS (SELECT text, lang, source, count(*) AS n FROM documents GROUP BY ALL)
SELECT sum(n)::bigint AS n_rows, 3::bigint AS n_columns, 0::bigint AS missing_cells,
       0.0::double AS missing_pct, sum(n - 1)::bigint AS duplicate_rows FROM d""")
def prof_overview(t):
    return profile.overview(t.documents.select(*DOCUMENT_COLUMNS))


@query("prof_missing", f"""
WITH e AS {EVENTS_WITH_GAPS}, c AS (
  SELECT 'event_type' AS "column", count_if(event_type IS NULL)::bigint AS missing, count(*) AS n FROM e
  UNION ALL SELECT 'value', count_if(value IS NULL)::bigint, count(*) FROM e)
SELECT "column", missing, round(missing * 100.0::double / n, 4) AS missing_pct FROM c""")
def prof_missing(t):
    return profile.missing_by_column(events_with_gaps(t))


LINEITEM = {
    "l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer",
    "l_linenumber": "integer", "l_quantity": "float", "l_extendedprice": "float",
    "l_discount": "float", "l_tax": "float", "l_returnflag": "string", "l_linestatus": "string",
    "l_shipdate": "datetime",
}


@query("prof_cardinality", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", '{k}' AS dtype, count(DISTINCT {c}) AS nunique FROM lineitem"
    for c, k in LINEITEM.items()))
def prof_cardinality(t):
    return profile.cardinality(t.lineitem)


_NUMERIC = [c for c, k in LINEITEM.items() if k in ("integer", "float")]


@query("prof_corr_matrix", "\nUNION ALL\n".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}::double, {b}::double), 4) AS correlation FROM lineitem"
    for i, a in enumerate(_NUMERIC) for b in _NUMERIC[i + 1:]))
def prof_corr_matrix(t):
    return profile.correlation_pairs(t.lineitem)


@query("prof_histogram", """
WITH e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 30 AS w FROM events),
h AS (SELECT cast(least(floor((value - lo) / w), 29) as int) AS bin, count(*) AS n FROM events, e GROUP BY 1)
SELECT g.bin::int AS bin, round(lo + g.bin * w, 6) AS bin_start, round(lo + (g.bin + 1) * w, 6) AS bin_end,
       coalesce(n, 0)::bigint AS n
FROM (SELECT unnest(range(30)) AS bin) g CROSS JOIN e LEFT JOIN h ON h.bin = g.bin""")
def prof_histogram(t):
    return profile.histogram(t.events, "value", 30)


@query("prof_value_counts", """
SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, value LIMIT 20""")
def prof_value_counts(t):
    return profile.top_values(t.orders, "o_orderpriority")


@query("prof_box_by_class", """
WITH x AS (""" + "\nUNION ALL\n".join(
    f"SELECT l_linestatus AS class, '{c}' AS feature, {c}::double AS x FROM lineitem" for c in _NUMERIC) + """),
q AS (SELECT class, feature, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) AS q3
      FROM x GROUP BY ALL)
SELECT class, feature, count(*) AS n_rows, round(min(x), 4) AS lowest, round(q1, 4) AS q1,
  round(m, 4) AS median, round(q3, 4) AS q3, round(max(x), 4) AS highest,
  round(min(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS whisker_low,
  round(max(x) FILTER (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 4) AS whisker_high,
  count_if(NOT (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)))::bigint AS outliers
FROM x JOIN q USING (class, feature) GROUP BY class, feature, q1, m, q3""")
def prof_box_by_class(t):
    return profile.box_by_class(t.lineitem, "l_linestatus")


ORDERS = {
    "o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string",
    "o_totalprice": "float", "o_orderdate": "datetime", "o_orderpriority": "string",
}
_ORDERS_FACTS = "\nUNION ALL\n".join(
    f"SELECT {i} AS position, '{c}' AS \"column\", '{k}' AS dtype, count(DISTINCT {c}) AS nunique, count(*) AS n FROM orders"
    for i, (c, k) in enumerate(ORDERS.items()))
ORDERS_ROLES = f"""
WITH f AS ({_ORDERS_FACTS})
SELECT "column", dtype, nunique,
  cast(nunique = n OR (dtype <> 'string' AND n > 50 AND nunique / n::double > 0.95)
       OR regexp_matches(lower("column"), '{vocab.ID_NAME}') as int) AS is_id,
  cast(dtype IN ('integer', 'float') as int) AS is_numeric,
  cast(dtype = 'string' as int) AS is_categorical,
  cast(dtype = 'string' AND nunique <= 50 as int) AS is_low_card,
  cast(dtype = 'string' AND nunique > 50 as int) AS is_high_card
FROM f"""


@query("prof_column_roles", ORDERS_ROLES)
def prof_column_roles(t):
    return roles.roles_table(t.orders)


@query("prof_positive_hint", """
SELECT round(avg(cast(lower(quality::varchar) IN ('1', 'yes', 'true', 'churn', 'positive') as double)), 6) AS positive_rate
FROM labels""")
def prof_positive_hint(t):
    return profile.positive_hint(t.labels, "quality", vocab.POSITIVE_HINT_WORDS)


@query("prof_dataset_health", f"""
WITH r AS ({ORDERS_ROLES}), d AS (SELECT count(*) AS n FROM orders GROUP BY ALL),
o AS (SELECT count(*) AS n_rows FROM orders), u AS (SELECT count(*) AS k FROM (SELECT DISTINCT * FROM orders))
SELECT n_rows, 6::bigint AS n_columns, 0::bigint AS missing_cells, 0.0::double AS missing_pct,
  (n_rows - k)::bigint AS duplicate_rows,
  (SELECT sum(is_id) FROM r)::bigint AS id_like_columns,
  (SELECT sum(is_low_card) FROM r)::bigint AS low_card_columns,
  (SELECT sum(is_high_card) FROM r)::bigint AS high_card_columns FROM o, u""")
def prof_dataset_health(t):
    return profile.dataset_health(t.orders)
