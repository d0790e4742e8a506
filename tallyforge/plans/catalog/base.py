"""The query register and SQL fragments used on both sides of a check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.hashing import hash_bucket
from tallyforge.session import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Registers ``function(tables) -> DataFrame`` under ``key``."""

    def register(function):
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(Tables(spark, folder))

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return function

    return register


def sql_bucket(key: str, seed, buckets: int) -> str:
    """The oracle's form of ``hash_bucket``."""
    return (f"(concat('0x', substr(md5(concat('{seed}:', cast({key} as varchar))), 1, 8))::bigint"
            f" % {buckets})")


def union_all(template: str, names, **parts) -> str:
    """One SELECT per name, joined by UNION ALL."""
    return "\nUNION ALL\n".join(
        template.replace("{c}", n).replace("{i}", str(i)) for i, n in enumerate(names))


# -- derived inputs: whole tables with gaps or scores added by rule -----------------------------

def events_with_gaps(t: Tables) -> DataFrame:
    """All events; the test tables have no nulls, so some are planted by rule."""
    return t.events.withColumns({
        "value": F.when(F.col("event_id") % 7 != 0, F.col("value")),
        "event_type": F.when(F.col("event_id") % 11 != 0, F.col("event_type")),
    })


EVENTS_WITH_GAPS = """(SELECT event_id, ts, user_id,
    CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type,
    CASE WHEN event_id % 7 <> 0 THEN value END AS value, props FROM events)"""


def orders_with_gaps(t: Tables) -> DataFrame:
    return t.orders.withColumns({
        "o_orderpriority": F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority")),
        "o_orderstatus": F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderstatus")),
    })


ORDERS_WITH_GAPS = """(SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate,
    CASE WHEN o_orderkey % 13 <> 0 THEN o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS o_orderpriority FROM orders)"""


def scored_events(t: Tables) -> DataFrame:
    """All events with a probability, a label that follows it and the 0.5 decision."""
    score = F.round(1.0 / (1.0 + F.exp(-(F.col("value") - 50.0) / 25.0)), 6)
    return t.events.select("event_id", "ts", "user_id", "event_type", "value",
                           score.alias("score")).withColumns({
        "label": (hash_bucket("event_id", 7, 100) < F.col("score") * 100).cast("int"),
        "prediction": (F.col("score") >= 0.5).cast("int"),
    })


SCORED_EVENTS = f"""(SELECT *, cast({sql_bucket('event_id', 7, 100)} < score * 100 as int) AS label,
    cast(score >= 0.5 as int) AS prediction FROM (
    SELECT event_id, ts, user_id, event_type, value,
      round(1.0::double / (1.0::double + exp(-(value - 50.0::double) / 25.0::double)), 6) AS score
    FROM events))"""


def labelled_documents(t: Tables, target: str = "quality") -> DataFrame:
    """All labelled documents with their features and one target."""
    return t.documents.join(t.labels, "doc_id").select(
        "doc_id", "n_chars", "lang", "source", F.col(target))


LABELLED_DOCUMENTS = """(SELECT d.doc_id, d.n_chars, d.lang, d.source, l.quality, l.toxic
    FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
