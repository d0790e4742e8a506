"""Finding and grading the time axis of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import vocab
from tallyforge.functions.columns import families, scalar_row
from tallyforge.operators.roles import parse_datetime_text

# Nanosecond clocks of 64 bits end in 1677 and 2262; numbers beyond do not read as a time.
_LIMIT_MICROS = 9_223_372_036_854_775
_UNITS = ("s", "ms", "us", "ns")
_MICROS = {"s": 1_000_000, "ms": 1_000, "us": 1}


def _epoch(name: str, unit: str) -> Column:
    number = F.col(name)
    if unit == "ns":
        size = number.cast("double") / F.lit(1000.0)
        micros = F.expr(f"cast(`{name}` as decimal(38, 0)) div 1000")
    else:
        size = number.cast("double") * F.lit(float(_MICROS[unit]))
        micros = number.cast("decimal(28, 6)") * F.lit(_MICROS[unit])
    sane = F.abs(size) < F.lit(float(_LIMIT_MICROS))
    return F.when(sane, F.timestamp_micros(micros.cast("bigint"))).cast("timestamp_ntz")


def readings(df: DataFrame, column: str) -> dict[str, Column]:
    """The ways to read a column as time, in order of preference."""
    kind = families(df)[column]
    if kind == "datetime":
        return {"direct": F.col(column).cast("timestamp_ntz")}
    if kind == "string":
        return {"direct": parse_datetime_text(F.col(column))}
    if kind in ("integer", "float"):
        # a bare number is read as nanoseconds first
        return {"direct": _epoch(column, "ns"), **{u: _epoch(column, u) for u in _UNITS}}
    return {"direct": F.lit(None).cast("timestamp_ntz")}


def best_reading(df: DataFrame, column: str) -> tuple[str, Column]:
    """The reading with the most valid values, the first one on a tie."""
    ways = readings(df, column)
    if len(ways) == 1:
        return next(iter(ways.items()))
    counts = scalar_row(df.agg(*[F.count(c).alias(n) for n, c in ways.items()]))
    name = max(ways, key=lambda n: (counts[n], -list(ways).index(n)))
    return name, ways[name]


def parse_timestamp(df: DataFrame, column: str, out: str) -> DataFrame:
    return df.withColumn(out, best_reading(df, column)[1])


def _grade(facts: DataFrame) -> DataFrame:
    """Quality numbers from total, valid, n_unique, first, last and epoch counts."""
    valid = F.col("valid").cast("double")
    span = F.when(
        F.col("unique_count") > 1,
        F.timestamp_diff("MICROSECOND", F.col("first_seen"), F.col("last_seen")) / F.lit(1e6),
    ).otherwise(F.lit(0.0))
    some = F.col("valid") > 0
    shaped = facts.select(
        "column",
        F.coalesce(F.try_divide(valid, F.col("total")), F.lit(0.0)).alias("valid_ratio"),
        "unique_count",
        F.coalesce(F.try_divide(F.col("unique_count"), valid), F.lit(0.0)).alias("unique_ratio"),
        span.alias("span_seconds"),
        F.when(some, F.col("epoch_rows") / valid).otherwise(F.lit(1.0)).alias("epoch_1970_ratio"),
        "valid",
    )
    enough = F.when(F.col("valid") >= 200, F.lit(10)).otherwise(F.lit(3))
    ok = (
        (F.col("valid_ratio") >= 0.60) & (F.col("unique_count") >= enough)
        & (F.col("unique_ratio") >= 0.01) & (F.col("epoch_1970_ratio") < 0.80)
        & (F.col("span_seconds") > 0)
    )
    score = (
        0.50 * F.col("valid_ratio")
        + 0.25 * F.least(F.lit(1.0), F.col("unique_ratio") * 10)
        + 0.15 * (1.0 - F.least(F.lit(1.0), F.col("epoch_1970_ratio")))
        + F.when(F.col("span_seconds") > 0, F.lit(0.10)).otherwise(F.lit(0.0))
    )
    return shaped.select(
        "column",
        F.round("valid_ratio", 6).alias("valid_ratio"),
        "unique_count",
        F.round("unique_ratio", 6).alias("unique_ratio"),
        F.round("span_seconds", 3).alias("span_seconds"),
        F.round("epoch_1970_ratio", 6).alias("epoch_1970_ratio"),
        F.coalesce(ok, F.lit(False)).cast("int").alias("is_valid"),
        F.when(some, score).otherwise(F.lit(0.0)).alias("quality"),
    )


def timestamp_quality(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quality of each column as a time axis; all columns share one aggregation."""
    parsed = df.select([best_reading(df, c)[1].alias(c) for c in columns])
    long = parsed.unpivot([], columns, "column", "t")
    counted = long.groupBy("column", "t").agg(F.count("*").alias("n"))
    present = F.col("t").isNotNull()
    facts = counted.groupBy("column").agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("valid"),
        F.count("t").alias("unique_count"),
        F.min("t").alias("first_seen"),
        F.max("t").alias("last_seen"),
        F.coalesce(F.sum(F.when(F.year("t") == 1970, F.col("n"))), F.lit(0)).alias("epoch_rows"),
    )
    return _grade(facts)


def detect_time_axis(df: DataFrame, top: int = 5) -> DataFrame:
    """Candidate time columns by quality plus 0.10 for a telling name; ties by position."""
    kind = families(df)
    hinted = {c: any(t in c.lower() for t in vocab.TIME_TOKENS) for c in df.columns}
    columns = [
        c for c in df.columns
        if kind[c] != "other" and (hinted[c] or kind[c] in ("datetime", "integer", "float", "string"))
    ]
    name = F.col("column")
    hint = name.isin(*[c for c in columns if hinted[c]] or [""])
    place = F.coalesce(*[F.when(name == c, F.lit(i)) for i, c in enumerate(columns)])
    return (
        timestamp_quality(df, columns)
        .withColumn("name_hint", hint.cast("int"))
        .withColumn("score", F.round(F.col("quality") + 0.10 * F.col("name_hint"), 6))
        .orderBy(F.desc("score"), place)
        .limit(top)
        .drop("quality")
    )


def resolve_mode(df: DataFrame, requested: str = "Auto") -> dict:
    """Time-series or tabular, with the chosen column and whether the request was dropped."""
    best = detect_time_axis(df, 1).first() if requested != "Tabular" else None
    usable = bool(best and best.is_valid)
    timed = requested != "Tabular" and usable
    return {
        "requested": requested,
        "resolved": "Time-series" if timed else "Tabular",
        "column": best["column"] if timed else None,
        "fallback": requested == "Time-series" and not usable,
    }
