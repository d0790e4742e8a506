"""Type families, null handling and small expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FRACTIONAL = (T.DoubleType, T.FloatType, T.DecimalType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_DATETIME = (T.TimestampType, T.TimestampNTZType, T.DateType)


def dtype_family(dtype: T.DataType) -> str:
    """One of integer, float, string, boolean, datetime, other."""
    if isinstance(dtype, _INTEGRAL):
        return "integer"
    if isinstance(dtype, _FRACTIONAL):
        return "float"
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, _DATETIME):
        return "datetime"
    return "other"


def families(df: DataFrame) -> dict[str, str]:
    return {f.name: dtype_family(f.dataType) for f in df.schema.fields}


def _of(df: DataFrame, wanted: Iterable[str], exclude: Iterable[str]) -> list[str]:
    wanted, exclude = set(wanted), set(exclude)
    return [c for c, fam in families(df).items() if fam in wanted and c not in exclude]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return _of(df, ("integer", "float"), exclude)


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return _of(df, ("string",), exclude)


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    """Strings and booleans: a boolean is a category here, not a number."""
    return _of(df, ("string", "boolean"), exclude)


def datetime_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return _of(df, ("datetime",), exclude)


def scalar_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return [c for c, fam in families(df).items() if fam != "other" and c not in set(exclude)]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a value in Spark; every operator here expects missing numbers to be null."""
    floats = {
        f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floats) if floats else df


def days_between(later: Column, earlier: Column) -> Column:
    micros = F.timestamp_diff("MICROSECOND", earlier, later)
    return micros.cast("double") / F.lit(86_400_000_000.0)


def seconds_between(later: Column, earlier: Column) -> Column:
    micros = F.timestamp_diff("MICROSECOND", earlier, later)
    return micros.cast("double") / F.lit(1_000_000.0)


def timestamp_literal(value) -> Column:
    """A zone-free literal; a Python datetime literal would go through the session time zone."""
    text = None if value is None else value.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def scalar_row(df: DataFrame) -> Row:
    """The one row of a global aggregate. The only way operators bring statistics to the driver."""
    return df.first()


def best_name(columns: Iterable[str], tokens: Iterable[str]) -> str | None:
    """First column whose lower-case name holds any of the tokens."""
    tokens = list(tokens)
    return next((c for c in columns if any(t in c.lower() for t in tokens)), None)
