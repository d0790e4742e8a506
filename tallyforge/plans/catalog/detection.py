from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions import vocab
from tallyforge.operators import roles, timeaxis
from tallyforge.plans.catalog.base import LABELLED_DOCUMENTS, query
from tallyforge.plans.catalog.profiling import ORDERS, _ORDERS_FACTS


@query("detect_task_type", f"""
WITH f AS ({_ORDERS_FACTS})
SELECT "column", nunique, CASE WHEN dtype = 'string' OR (nunique <= 20 AND dtype <> 'float')
  THEN 'classification' ELSE 'regression' END AS task FROM f""")
def detect_task_type(t):
    return roles.task_types(t.orders)


_TOKENS = " OR ".join(f"contains(c, '{w}')" for w in vocab.TARGET_TOKENS)


@query("detect_target", f"""
WITH d AS {LABELLED_DOCUMENTS}, f AS (
  SELECT 0 AS p, 'doc_id' AS c, 'n' AS k, count(DISTINCT doc_id) AS u, count(*) AS n FROM d
  UNION ALL SELECT 1, 'n_chars', 'n', count(DISTINCT n_chars), count(*) FROM d
  UNION ALL SELECT 2, 'lang', 's', count(DISTINCT lang), count(*) FROM d
  UNION ALL SELECT 3, 'source', 's', count(DISTINCT source), count(*) FROM d
  UNION ALL SELECT 4, 'quality', 'n', count(DISTINCT quality), count(*) FROM d),
s AS (SELECT p, c, u, CASE WHEN {_TOKENS} THEN 4.0::double ELSE 0 END
  + CASE WHEN u / n::double <= 0.25 THEN 2.5 WHEN u / n::double <= 0.6 THEN 1.0 ELSE 0 END
  - CASE WHEN u / n::double >= 0.95 AND n > 80 THEN 4.0 ELSE 0 END
  + CASE WHEN k = 'n' THEN 0.4 ELSE 0 END
  - CASE WHEN regexp_matches(c, '{vocab.ID_NAME_SHORT}') THEN 3.0 ELSE 0 END AS score FROM f)
SELECT c AS "column", u AS nunique, round(score, 4)::double AS score,
  cast(row_number() OVER (ORDER BY score DESC, p) = 1 as int) AS is_best FROM s""")
def detect_target(t):
    d = t.documents.join(t.labels, "doc_id")
    return roles.target_scores(d.select("doc_id", "n_chars", "lang", "source", "quality"))


@query("detect_churn_column", """
WITH f AS (SELECT 'doc_id' AS c, 0 AS p, count(DISTINCT doc_id) AS k, min(doc_id)::varchar AS a, max(doc_id)::varchar AS b FROM labels
  UNION ALL SELECT 'quality', 1, count(DISTINCT quality), min(quality)::varchar, max(quality)::varchar FROM labels
  UNION ALL SELECT 'toxic', 2, count(DISTINCT toxic), min(toxic)::varchar, max(toxic)::varchar FROM labels)
SELECT 'labels' AS "table", c AS "column" FROM f WHERE k = 2 AND a = '0' AND b = '1' ORDER BY p LIMIT 1""")
def detect_churn_column(t):
    found = roles.detect_churn_column(t.labels)
    return t.spark.createDataFrame([("labels", found)], "table string, column string")


def _entity_facts(table: str, columns: dict) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{c}' AS c, '{k}' AS k, count(DISTINCT {c}) AS u, count(*) AS n FROM {table}"
        for c, k in columns.items())


def _sum_of(patterns) -> str:
    return " + ".join(
        f"CASE WHEN regexp_matches(c, '{p}') THEN {w}::double ELSE 0 END" for p, w in patterns)


def _entity_scores(table: str, columns: dict) -> str:
    return f"""(SELECT c, k, u, u / n::double AS ratio, name, name
      + greatest(0.0, 1.0 - u / n::double) * 0.5 - CASE WHEN u / n::double > 0.7 THEN 1.0 ELSE 0 END AS total
    FROM (SELECT *, {_sum_of(vocab.ENTITY_NAME_WEIGHTS)} - ({_sum_of(vocab.ENTITY_NAME_DEDUCTIONS)}) AS name
      FROM ({_entity_facts(table, columns)})))"""


_EVENTS = {"event_id": "integer", "ts": "datetime", "user_id": "integer", "event_type": "string",
           "value": "float", "props": "string"}


@query("detect_entity_column", f"""
SELECT 'events' AS "table", c AS "column" FROM {_entity_scores('events', _EVENTS)}
WHERE k IN ('integer', 'string') AND ratio BETWEEN 0.005 AND 0.98 AND total > 0 ORDER BY total DESC LIMIT 1""")
def detect_entity_column(t):
    found = roles.detect_entity_column(t.events)
    return t.spark.createDataFrame([("events", found)], "table string, column string")


@query("rank_entity_candidates", f"""
SELECT c AS "column", k AS dtype, cast(k = 'datetime' as int) AS is_datetime, u AS unique_count,
  round(ratio, 4) AS unique_ratio, round(name, 2) AS name_score, round(total, 2) AS total_score,
  cast(ratio BETWEEN 0.005 AND 0.98 as int) AS cardinality_ok
FROM {_entity_scores('orders', ORDERS)}""")
def rank_entity_candidates(t):
    return roles.entity_table(t.orders)


@query("detect_datetime_columns", """
SELECT * FROM (VALUES ('event_id', 0.0::double, 0), ('user_id', 0.0, 0), ('value', 0.0, 0)) v("column", parse_ratio, is_datetime)
UNION ALL SELECT 'ts', round(count(try_cast(ts::varchar as timestamp)) / count(*)::double, 6),
  cast(count(try_cast(ts::varchar as timestamp)) / count(*)::double >= 0.8 as int) FROM events
UNION ALL SELECT 'event_type', round(count(try_cast(event_type as timestamp)) / count(*)::double, 6),
  cast(count(try_cast(event_type as timestamp)) / count(*)::double >= 0.8 as int) FROM events
UNION ALL SELECT 'props', round(count(try_cast(props as timestamp)) / count(*)::double, 6),
  cast(count(try_cast(props as timestamp)) / count(*)::double >= 0.8 as int) FROM events""")
def detect_datetime_columns(t):
    return roles.datetime_table(t.events.withColumn("ts", F.col("ts").cast("string")))


@query("is_transactional", """
WITH a AS (SELECT 'user_id' AS entity, count(*) AS n, count(DISTINCT user_id) AS k FROM events
  UNION ALL SELECT 'c_custkey', count(*), count(DISTINCT c_custkey) FROM customer)
SELECT entity, n AS n_rows, k AS n_entities, round(n / k::double, 4) AS rows_per_entity,
  cast(n / k::double >= 1.5 as int) AS is_transactional FROM a""")
def is_transactional(t):
    return roles.transactional(t.events, "user_id").unionByName(
        roles.transactional(t.customer, "c_custkey"))


@query("parse_timestamp", """
SELECT event_id, make_timestamp(epoch_us(ts) // 1000 // 1000) AS parsed FROM events""")
def parse_timestamp(t):
    """A clock in milliseconds: every unit reads, so the first one, nanoseconds, is kept."""
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    e = t.events.select("event_id", millis.alias("clock"))
    return timeaxis.parse_timestamp(e, "clock", "parsed").select("event_id", "parsed")


def _quality(table: str, facts: str) -> str:
    return f"""q AS (SELECT c, total, valid, u, first_seen, last_seen, epoch_rows,
    valid / total::double AS vr, coalesce(u / nullif(valid, 0)::double, 0) AS ur,
    CASE WHEN u > 1 THEN date_diff('microsecond', first_seen, last_seen) / 1e6 ELSE 0 END::double AS span,
    coalesce(epoch_rows / nullif(valid, 0)::double, 1.0) AS er FROM ({facts})),
  g AS (SELECT *, CASE WHEN valid = 0 THEN 0 ELSE 0.50::double * vr + 0.25::double * least(1.0, ur * 10)
      + 0.15::double * (1.0 - least(1.0, er)) + CASE WHEN span > 0 THEN 0.10::double ELSE 0 END END AS quality,
    cast(vr >= 0.60 AND u >= CASE WHEN valid >= 200 THEN 10 ELSE 3 END AND ur >= 0.01 AND er < 0.80 AND span > 0 as int) AS ok
    FROM q)"""


_TS_FACTS = """SELECT 'ts' AS c, 1 AS p, count(*) AS total, count(ts) AS valid, count(DISTINCT ts) AS u,
  min(ts) AS first_seen, max(ts) AS last_seen, count_if(year(ts) = 1970) AS epoch_rows FROM events"""
_GRADES = """c AS "column", round(vr, 6) AS valid_ratio, u AS unique_count, round(ur, 6) AS unique_ratio,
  round(span, 3) AS span_seconds, round(er, 6) AS epoch_1970_ratio, ok AS is_valid"""


@query("timestamp_quality", f"""
WITH {_quality('events', _TS_FACTS)}
SELECT {_GRADES}, round(quality, 6) AS quality FROM g""")
def timestamp_quality(t):
    return timeaxis.timestamp_quality(t.events, ["ts"]).withColumn("quality", F.round("quality", 6))


def _number_facts(c: str, p: int) -> str:
    # the first unit with the most readable values is nanoseconds, in which all of them are in range
    moment = f"make_timestamp(cast(trunc({c}) as bigint) // 1000)"
    return (f"SELECT '{c}', {p}, count(*), count({c}), count(DISTINCT {moment}), min({moment}), "
            f"max({moment}), count_if(year({moment}) = 1970) FROM events")


def _text_facts(c: str, p: int) -> str:
    moment = f"try_cast({c} as timestamp)"
    return (f"SELECT '{c}', {p}, count(*), count({moment}), count(DISTINCT {moment}), min({moment}), "
            f"max({moment}), 0 FROM events")


_AXIS_FACTS = "\nUNION ALL\n".join([
    _TS_FACTS, _number_facts("event_id", 0), _number_facts("user_id", 2),
    _text_facts("event_type", 3), _number_facts("value", 4), _text_facts("props", 5)])
_HINT = " OR ".join(f"contains(c, '{w}')" for w in vocab.TIME_TOKENS)


@query("detect_time_axis", f"""
WITH {_quality('events', _AXIS_FACTS)},
o AS (SELECT *, cast({_HINT} as int) AS hint,
  CASE c WHEN 'event_id' THEN 0 WHEN 'ts' THEN 1 WHEN 'user_id' THEN 2 WHEN 'event_type' THEN 3 WHEN 'value' THEN 4 ELSE 5 END AS p FROM g)
SELECT {_GRADES}, hint AS name_hint, round(quality + 0.10::double * hint, 6) AS score FROM o
ORDER BY score DESC, p LIMIT 5""")
def detect_time_axis(t):
    return timeaxis.detect_time_axis(t.events)


@query("encode_binary_target", """
WITH r AS (SELECT lower(event_type) AS v FROM events GROUP BY 1 ORDER BY count(*), v DESC LIMIT 1)
SELECT 'event_type' AS target, event_type AS value, cast(lower(event_type) = (SELECT v FROM r) as int) AS label, count(*) AS n
FROM events GROUP BY ALL
UNION ALL SELECT 'quality', quality::varchar, cast(quality = 1 as int), count(*) FROM labels GROUP BY ALL""")
def encode_binary_target(t):
    def counted(df, target):
        label = roles.binary_target(df, target)
        return df.groupBy(F.lit(target).alias("target"), F.col(target).cast("string").alias("value"),
                          label.alias("label")).agg(F.count("*").alias("n"))

    return counted(t.events, "event_type").unionByName(counted(t.labels, "quality"))


@query("label_index", """
SELECT value, (row_number() OVER (ORDER BY value) - 1)::bigint AS code FROM (SELECT DISTINCT o_orderstatus AS value FROM orders)""")
def label_index(t):
    return roles.label_mapping(t.orders, "o_orderstatus")


@query("numeric_target", """
WITH m AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS code FROM (SELECT DISTINCT o_orderpriority AS value FROM orders))
SELECT o_orderkey, code::double AS code FROM orders JOIN m ON o_orderpriority = value""")
def numeric_target(t):
    return roles.with_codes(t.orders, "o_orderpriority", "code").select("o_orderkey", "code")
