from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from tallyforge.plans.catalog.base import events_with_gaps, query
from tallyforge.session import shared_folder
from tallyforge.sources.delimited import read_delimited, write_delimited
from tallyforge.sources.inspect import metadata, preview, validate


def _scratch(t, name: str) -> str:
    return os.path.join(shared_folder(t.spark), f"{name}-{uuid.uuid4().hex}")


@query("src_delimited", """
SELECT event_id, user_id, event_type, round(value, 4) AS value FROM events""")
def src_delimited(t):
    """All events as text, a line with a surplus field after each hundredth row, read back."""
    path = _scratch(t, "delimited")
    line = F.concat_ws(";", "event_id", "user_id", "event_type", "value")
    lines = F.when(F.col("event_id") % 100 == 0, F.array(line, F.concat(line, F.lit(";x;y"))))
    body = t.events.select(F.explode(F.coalesce(lines, F.array(line))).alias("event_id;user_id;event_type;value"))
    # quoting off, so each value is written as the raw line under the header line
    body.write.option("header", True).option("sep", "\u0001").option("quote", "").csv(path)
    return read_delimited(t.spark, path, sep=None).select(
        F.col("event_id").cast("bigint").alias("event_id"),
        F.col("user_id").cast("bigint").alias("user_id"),
        "event_type", F.round("value", 4).alias("value"))


@query("src_validate", """
WITH c AS (SELECT count(*) AS n, count(o_orderstatus) AS k FROM orders)
SELECT 'not_empty' AS rule, cast(n > 0 as int) AS passed, n AS detail FROM c
UNION ALL SELECT 'min_rows', cast(n >= 10 as int), n FROM c
UNION ALL SELECT 'min_columns', 1, 6 FROM c
UNION ALL SELECT 'file_type', 1, 1 FROM c
UNION ALL SELECT 'min_target_rows', cast(k >= 20 as int), k FROM c""")
def src_validate(t):
    return validate(t.orders, "o_orderstatus", ".csv")


@query("src_metadata", """
SELECT 0 AS position, 'event_id' AS "column", 'integer' AS dtype, count(*) AS n_rows, 0::bigint AS missing FROM events
UNION ALL SELECT 1, 'ts', 'datetime', count(*), 0 FROM events
UNION ALL SELECT 2, 'user_id', 'integer', count(*), 0 FROM events
UNION ALL SELECT 3, 'event_type', 'string', count(*), count_if(event_id % 11 = 0)::bigint FROM events
UNION ALL SELECT 4, 'value', 'float', count(*), count_if(event_id % 7 = 0)::bigint FROM events
UNION ALL SELECT 5, 'props', 'string', count(*), 0 FROM events""")
def src_metadata(t):
    return metadata(events_with_gaps(t))


@query("src_preview", "SELECT * FROM part ORDER BY p_partkey LIMIT 5")
def src_preview(t):
    return preview(t.part, "p_partkey")


@query("sink_delimited", """
SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def sink_delimited(t):
    path = _scratch(t, "customer")
    write_delimited(t.customer, path)
    return read_delimited(t.spark, path, schema=t.customer.schema)
