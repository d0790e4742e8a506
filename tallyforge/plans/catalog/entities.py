from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.functions.columns import scalar_row
from tallyforge.operators import entity
from tallyforge.plans.catalog.base import query

ROUNDED = ("mean", "sum", "min", "max", "std")


def _rounded(df, column):
    return df.withColumns({f"{column}_{m}": F.round(f"{column}_{m}", 4) for m in ROUNDED})


def numeric_sql(c: str) -> str:
    return (f"round(avg({c}), 4) AS {c}_mean, round(sum({c}), 4) AS {c}_sum, round(min({c}), 4) AS {c}_min, "
            f"round(max({c}), 4) AS {c}_max, round(stddev_samp({c}), 4) AS {c}_std, count({c}) AS {c}_count")


def mode_sql(table: str, key: str, c: str) -> str:
    return (f"(SELECT {key}, {c} AS {c}_mode, u AS {c}_nunique FROM (SELECT {key}, {c}, "
            f"count(*) OVER (PARTITION BY {key}) AS u, "
            f"row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, {c}) AS r "
            f"FROM {table} GROUP BY {key}, {c}) WHERE r = 1)")


@query("ent_numeric", f"SELECT user_id, {numeric_sql('value')} FROM events GROUP BY user_id")
def ent_numeric(t):
    return _rounded(t.events.groupBy("user_id").agg(*entity.numeric_measures("value")), "value")


@query("ent_categorical", f"SELECT * FROM {mode_sql('events', 'user_id', 'event_type')}")
def ent_categorical(t):
    return t.events.groupBy("user_id").agg(*entity.category_measures("event_type"))


_DATES = """min({c}) AS {c}_min, max({c}) AS {c}_max,
  round(date_diff('microsecond', max({c}), (SELECT max({c}) FROM {t})) / 86400000000.0::double, 6) AS {c}_recency_days,
  round(date_diff('microsecond', min({c}), max({c})) / 86400000000.0::double, 6) AS {c}_tenure_days"""


@query("ent_datetime", "SELECT o_custkey, " + _DATES.format(c="o_orderdate", t="orders")
       + " FROM orders GROUP BY o_custkey")
def ent_datetime(t):
    latest = scalar_row(t.orders.agg(F.max("o_orderdate").alias("d"))).d
    out = t.orders.groupBy("o_custkey").agg(*entity.datetime_measures("o_orderdate", latest))
    return out.withColumns({c: F.round(c, 6) for c in
                            ("o_orderdate_recency_days", "o_orderdate_tenure_days")})


@query("ent_target", f"""
WITH b AS (SELECT user_id, max(cast(value > 100 as int)) AS flag FROM events GROUP BY user_id)
SELECT 'events' AS source, user_id AS entity, flag::varchar AS target FROM b
UNION ALL SELECT 'orders', o_custkey, o_orderstatus_mode FROM {mode_sql('orders', 'o_custkey', 'o_orderstatus')}""")
def ent_target(t):
    flagged = t.events.select("user_id", (F.col("value") > 100).cast("int").alias("flag"))
    two = entity.target_by_entity(flagged, "user_id", "flag", 2)
    many = entity.target_by_entity(t.orders, "o_custkey", "o_orderstatus", 3)
    return two.select(F.lit("events").alias("source"), F.col("user_id").alias("entity"),
                      F.col("flag").cast("string").alias("target")).unionByName(
        many.select(F.lit("orders").alias("source"), F.col("o_custkey").alias("entity"),
                    F.col("o_orderstatus").alias("target")))


def user_features(t):
    """All events collapsed per user; ids and free text are left to the role detection."""
    events = t.events.drop("event_id")
    return entity.aggregate_entities(events)


@query("ent_aggregate", f"""
WITH a AS (SELECT user_id, {numeric_sql('value')}, {_DATES.format(c='ts', t='events')} FROM events GROUP BY user_id)
SELECT * FROM a JOIN {mode_sql('events', 'user_id', 'event_type')} m USING (user_id)""")
def ent_aggregate(t):
    out = _rounded(user_features(t).table, "value")
    return out.withColumns({c: F.round(c, 6) for c in ("ts_recency_days", "ts_tenure_days")})


@query("ent_report", """
SELECT * FROM (VALUES ('value', 'numeric: mean, sum, min, max, std, count'), ('event_type', 'category: mode, nunique'),
 ('ts', 'datetime: min, max, recency_days, tenure_days'), ('props', 'skipped: many distinct values or unsupported type')) v("column", rule)""")
def ent_report(t):
    return user_features(t).report()
