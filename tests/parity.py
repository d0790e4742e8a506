"""Compares the Spark result of a query with its SQL on the same tables.

``python -m tests.parity [--sf 0.01] [key ...]`` prints one line per key.
"""

from __future__ import annotations

import argparse
import math
import time
import traceback
from datetime import date, datetime

import duckdb

from tallyforge.session import TABLES

ROOT = "/root/testdata"


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if value is None:
        return "NULL"
    if hasattr(value, "is_integer") or type(value).__name__ == "Decimal":
        return f"dec:{value}"
    return f"{type(value).__name__[0]}:{value}"


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark_df, con, sql: str) -> str:
    """Empty when equal, otherwise what differs."""
    mine = [tuple(r) for r in spark_df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    a, b = _sorted_rows(spark_df.columns, mine), _sorted_rows(names, theirs)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)}/{len(a)} rows differ, columns {sorted(names)}; first {bad[0]}"
    return "" if a else "both empty"


def main():
    from tallyforge.plans.catalog import ORACLES, QUERIES
    from tallyforge.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--prefix", default="")
    parser.add_argument("--weak", action="store_true", help="only queries without SQL")
    parser.add_argument("keys", nargs="*")
    args = parser.parse_args()
    folder = f"{ROOT}/sf{args.sf}"
    spark = local_session(8)
    con = connect(folder)
    keys = args.keys or [k for k in QUERIES if k.startswith(args.prefix)]
    if args.weak:
        keys = [k for k in keys if k not in ORACLES]
    bad = []
    for key in keys:
        begin = time.time()
        try:
            df = QUERIES[key](spark, folder)
            if key in ORACLES:
                outcome = compare(df, con, ORACLES[key]) or "ok"
            else:
                rows = df.collect()
                outcome = f"{len(rows)} rows, e.g. {rows[0].asDict() if rows else None}"
                outcome = "rows " + outcome[:400]
        except Exception as error:  # report and go on with the next key
            text = "".join(traceback.format_exception_only(error))
            where = [f for f in traceback.extract_tb(error.__traceback__) if "tallyforge" in f.filename]
            outcome = f"FAILED {where[-1].filename.split('/')[-1]}:{where[-1].lineno if where else ''} {text[:600]}" if where else f"FAILED {text[:900]}"
        print(f"{key:28s} {time.time() - begin:6.2f}s {outcome}", flush=True)
        if outcome != "ok" and not outcome.startswith("rows "):
            bad.append(key)
    print(f"{len(keys) - len(bad)}/{len(keys)} good; bad: {bad}")


if __name__ == "__main__":
    main()
