"""Which part each column plays: id, category, target, entity key, date."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import vocab
from tallyforge.functions.columns import (
    categorical_columns, dtype_family, families, numeric_columns, scalar_columns, scalar_row,
)
from tallyforge.operators.counts import collect_facts, value_counts
from tallyforge.session import broadcast_if_small


@dataclass
class ColumnRoles:
    ids: list[str] = field(default_factory=list)
    numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    low_card: list[str] = field(default_factory=list)
    high_card: list[str] = field(default_factory=list)
    nunique: dict[str, int] = field(default_factory=dict)

    def without_ids(self) -> "ColumnRoles":
        keep = lambda names: [c for c in names if c not in self.ids]
        return ColumnRoles(self.ids, keep(self.numeric), keep(self.categorical),
                           keep(self.low_card), keep(self.high_card), self.nunique)


def column_roles(df: DataFrame, exclude: Sequence[str] = (), strict_ids: bool = True) -> ColumnRoles:
    """Roles from distinct counts, types and names.

    An id is a column with no repeated value, a non-string column with more than 95 % distinct
    values (over 50 rows), or one whose name says so. ``strict_ids=False`` spares fractional
    columns from the first two rules.
    """
    columns = scalar_columns(df, exclude)
    kind = families(df)
    facts = collect_facts(df, columns)
    roles = ColumnRoles(nunique={c: facts[c].nunique for c in columns})
    for c in columns:
        n, distinct = facts[c].n_rows, facts[c].nunique
        by_values = n > 0 and (
            distinct == n or (kind[c] != "string" and n > 50 and distinct / n > 0.95)
        )
        if not strict_ids and kind[c] == "float":
            by_values = False
        if by_values or re.search(vocab.ID_NAME, c, re.IGNORECASE):
            roles.ids.append(c)
    roles.numeric = numeric_columns(df, exclude)
    roles.categorical = categorical_columns(df, exclude)
    roles.high_card = [c for c in roles.categorical if roles.nunique[c] > vocab.CATEGORY_LIMIT]
    roles.low_card = [c for c in roles.categorical if c not in roles.high_card]
    return roles


def roles_table(df: DataFrame) -> DataFrame:
    """The roles as rows (column, dtype, nunique and one flag per role)."""
    roles, kind = column_roles(df), families(df)
    rows = [
        (c, kind[c], roles.nunique[c], int(c in roles.ids), int(c in roles.numeric),
         int(c in roles.categorical), int(c in roles.low_card), int(c in roles.high_card))
        for c in roles.nunique
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, dtype string, nunique bigint, is_id int, is_numeric int, "
              "is_categorical int, is_low_card int, is_high_card int")


def task_type(kind: str, nunique: int) -> str:
    """Strings, and non-fractional columns of at most 20 values, are classes."""
    is_class = kind == "string" or (nunique <= 20 and kind != "float")
    return "classification" if is_class else "regression"


def task_types(df: DataFrame) -> DataFrame:
    kind, facts = families(df), collect_facts(df)
    rows = [(c, facts[c].nunique, task_type(kind[c], facts[c].nunique)) for c in facts]
    return df.sparkSession.createDataFrame(rows, "column string, nunique bigint, task string")


def target_scores(df: DataFrame) -> DataFrame:
    """Score of every column as the prediction target; the best has ``is_best`` 1.

    The first column wins a tie.
    """
    kind, facts = families(df), collect_facts(df)
    rows = []
    for position, c in enumerate(facts):
        name, f = c.lower(), facts[c]
        ratio = max(1, f.nunique) / max(1, f.n_rows - f.n_missing)
        points = (  # fixed values: what counts for and against a column
            (any(token in name for token in vocab.TARGET_TOKENS), 4.0),
            (ratio <= 0.25, 2.5),
            (0.25 < ratio <= 0.6, 1.0),
            (ratio >= 0.95 and f.n_rows > 80, -4.0),
            (kind[c] in ("integer", "float", "boolean"), 0.4),
            (bool(re.search(vocab.ID_NAME_SHORT, name)), -3.0),
        )
        gaps = f.n_missing / f.n_rows if f.n_rows else 0.0
        rows.append((c, position, f.nunique, sum(p for holds, p in points if holds) - 2.0 * gaps))
    best = max(rows, key=lambda r: (r[3], -r[1]))[0]
    return df.sparkSession.createDataFrame(
        [(c, n, round(s, 4), int(c == best)) for c, _, n, s in rows],
        "column string, nunique bigint, score double, is_best int")


def detect_target(df: DataFrame) -> str:
    return target_scores(df).filter("is_best = 1").first()["column"]


def _churn_name_rank(position: int, name: str) -> tuple | None:
    """Sort key of a name that speaks of churn: whole names first, in the order of the fixed lists."""
    plain = name.lower().replace(" ", "_")
    ranks = [(0, i) for i, word in enumerate(vocab.CHURN_NAMES) if plain == word]
    ranks += [(1, i) for i, part in enumerate(vocab.CHURN_NAME_PARTS) if part in plain]
    return (*ranks[0], position) if ranks else None


def detect_churn_column(df: DataFrame) -> str | None:
    """Target column of a churn table: the best name, else the first column with a known pair of values."""
    ranked = [(r, c) for i, c in enumerate(df.columns) if (r := _churn_name_rank(i, c))]
    if ranked:
        return min(ranked)[1]
    columns = scalar_columns(df)
    two_valued = (
        value_counts(df, columns).filter("value IS NOT NULL")
        .groupBy("column")
        .agg(F.count("*").alias("k"), F.min("value").alias("a"), F.max("value").alias("b"))
        .filter("k = 2")
        .collect()  # at most one row per column
    )
    found = {r["column"]: {r.a.lower(), r.b.lower()} for r in two_valued}
    pairs = [set(p) for p in vocab.CHURN_VALUE_PAIRS]
    return next((c for c in columns if found.get(c) in pairs), None)


def entity_name_score(name: str) -> float:
    low = name.lower().strip()
    gain = sum(w for pattern, w in vocab.ENTITY_NAME_WEIGHTS if re.search(pattern, low))
    loss = sum(w for pattern, w in vocab.ENTITY_NAME_DEDUCTIONS if re.search(pattern, low))
    return float(gain - loss)


def entity_candidates(df: DataFrame, target: str | None = None, facts: dict | None = None,
                      dates: Sequence[str] | None = None) -> list[dict]:
    """Every column with its score as the entity key, best first.

    Column facts and date columns that are already known are not computed again.
    """
    kind = families(df)
    columns = [
        c for c in scalar_columns(df)
        if c != target and c.lower().strip() not in vocab.ENTITY_SKIPPED_NAMES
    ]
    facts = collect_facts(df, columns) if facts is None else facts
    if dates is None:
        dates = detect_datetime_columns(df, exclude=[c for c in df.columns if c not in columns])
    low, high = vocab.ENTITY_RATIO_RANGE
    out = []
    for position, c in enumerate(columns):
        ratio = facts[c].nunique / max(1, facts[c].n_rows)
        bonus = max(0.0, 1.0 - ratio) * 0.5 - (1.0 if ratio > 0.7 else 0.0)
        name = entity_name_score(c)
        out.append({
            "column": c, "dtype": kind[c], "is_datetime": c in dates,
            "unique_count": facts[c].nunique, "unique_ratio": ratio, "name_score": name,
            "bonus": bonus, "total_score": name + bonus, "cardinality_ok": low <= ratio <= high,
            "position": position,
        })
    return sorted(out, key=lambda r: (-r["total_score"], r["position"]))


def entity_table(df: DataFrame, target: str | None = None) -> DataFrame:
    rows = [
        (r["column"], r["dtype"], int(r["is_datetime"]), r["unique_count"],
         round(r["unique_ratio"], 4), round(r["name_score"], 2), round(r["total_score"], 2),
         int(r["cardinality_ok"]))
        for r in entity_candidates(df, target)
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, dtype string, is_datetime int, unique_count bigint, "
              "unique_ratio double, name_score double, total_score double, cardinality_ok int")


def detect_entity_column(df: DataFrame, target: str | None = None, facts: dict | None = None,
                         dates: Sequence[str] | None = None) -> str | None:
    """The best string or integer column that repeats, or None when no score is positive."""
    for r in entity_candidates(df, target, facts, dates):
        usable = r["dtype"] in ("string", "integer") and not r["is_datetime"]
        if usable and r["cardinality_ok"] and r["unique_count"] > 0:
            return r["column"] if r["total_score"] > 0 else None
    return None


_DATE_FORMATS = (
    None, "yyyy/MM/dd", "yyyy/MM/dd HH:mm:ss", "MM/dd/yyyy", "MM/dd/yyyy HH:mm:ss", "dd-MM-yyyy",
)


def parse_datetime_text(text: Column) -> Column:
    """Timestamp of a date written in the usual forms, null when it is none."""
    shaped = text.rlike(r"^\s*\d{1,4}[-/]\d{1,2}[-/]\d{1,4}")
    forms = [
        F.try_to_timestamp(F.trim(text)) if f is None
        else F.try_to_timestamp(F.trim(text), F.lit(f))
        for f in _DATE_FORMATS
    ]
    return F.when(shaped, F.coalesce(*forms)).cast("timestamp_ntz")


def datetime_shares(df: DataFrame, exclude: Sequence[str] = ()) -> dict[str, float]:
    """Share of the non-null values of each string column that parse as a date."""
    strings = [c for c, fam in families(df).items() if fam == "string" and c not in exclude]
    if not strings:
        return {}
    row = scalar_row(df.agg(*[
        F.try_divide(F.count(parse_datetime_text(F.col(c))), F.count(c)).alias(c) for c in strings
    ]))
    return {c: float(row[c] or 0.0) for c in strings}


def detect_datetime_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Date-typed columns, and string columns of which at least 80 % parse."""
    kind, shares = families(df), datetime_shares(df, exclude)
    return [
        c for c in df.columns
        if c not in exclude
        and (kind[c] == "datetime" or shares.get(c, 0.0) >= vocab.DATETIME_PARSE_SHARE)
    ]


def coerce_datetimes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    strings = [c for c in columns if dtype_family(df.schema[c].dataType) == "string"]
    return df.withColumns({c: parse_datetime_text(F.col(c)) for c in strings}) if strings else df


def datetime_table(df: DataFrame) -> DataFrame:
    kind, shares = families(df), datetime_shares(df)
    rows = [
        (c, 1.0 if kind[c] == "datetime" else round(shares.get(c, 0.0), 6),
         int(kind[c] == "datetime" or shares.get(c, 0.0) >= vocab.DATETIME_PARSE_SHARE))
        for c in df.columns
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, parse_ratio double, is_datetime int")


def transactional(df: DataFrame, entity: str) -> DataFrame:
    """Rows, entities, rows per entity, and whether that is at least 1.5."""
    per_entity = df.groupBy(entity).agg(F.count("*").alias("n"))
    totals = per_entity.agg(
        F.sum("n").alias("n_rows"), F.count(entity).alias("n_entities"))
    ratio = F.try_divide(F.col("n_rows").cast("double"), F.col("n_entities"))
    return totals.select(
        F.lit(entity).alias("entity"), "n_rows", "n_entities",
        F.round(ratio, 4).alias("rows_per_entity"),
        F.coalesce(ratio >= vocab.ENTITY_MIN_ROWS, F.lit(False)).cast("int")
        .alias("is_transactional"),
    )


# -- target encoding ---------------------------------------------------------------------------

def _normal(column: Column) -> Column:
    return F.lower(F.trim(column.cast("string")))


def binary_target(df: DataFrame, target: str) -> Column:
    """0/1 expression for any two-way reading of the target; a missing value is 0.

    Known positive words are 1. Without any, the higher of two numbers is 1; otherwise the least
    frequent value is (the last one in order on a tie). Vocabulary is looked up with one small
    aggregate, the least frequent value by sorting counts in Spark.
    """
    y = F.col(target)
    known = vocab.POSITIVE_WORDS + vocab.NEGATIVE_WORDS
    word = _normal(y)
    seen = scalar_row(df.filter(y.isNotNull()).agg(
        F.max(word.isin(*vocab.POSITIVE_WORDS).cast("int")).alias("positive"),
        F.min(word.isin(*known).cast("int")).alias("all_known"),
        F.min(y).alias("lo"), F.max(y).alias("hi"),
    ))
    if seen.positive or seen.all_known:
        return F.coalesce(word.isin(*vocab.POSITIVE_WORDS), F.lit(False)).cast("int")
    numeric = dtype_family(df.schema[target].dataType) in ("integer", "float")
    if numeric:
        middle = df.filter(y.isNotNull() & (y != F.lit(seen.lo)) & (y != F.lit(seen.hi)))
        if seen.lo != seen.hi and middle.isEmpty():
            return F.coalesce(y == F.lit(seen.hi), F.lit(False)).cast("int")
        rare, value = df.filter(y.isNotNull()), y
    else:
        rare, value = df, F.lower(F.coalesce(y.cast("string"), F.lit("nan")))
    row = (
        rare.groupBy(value.alias("v")).agg(F.count("*").alias("n"))
        .orderBy("n", F.desc("v")).limit(1).first()
    )
    if row is None:
        return F.lit(0)
    return F.coalesce(value == F.lit(row.v), F.lit(False)).cast("int")


def label_mapping(df: DataFrame, target: str) -> DataFrame:
    """Sorted values of the target with codes 0..k-1, as a table ``(value, code)``.

    Positions come from the range-partitioned ordering, so a target with very many values needs
    no single sorted task.
    """
    from tallyforge.operators.ordering import positions

    distinct = df.select(F.col(target).alias("value")).filter("value IS NOT NULL").distinct()
    return positions(distinct, ["value"], "code").select("value", "code")


def with_codes(df: DataFrame, target: str, out: str) -> DataFrame:
    """Adds the sorted code of the target; numeric targets pass through as they are."""
    if dtype_family(df.schema[target].dataType) in ("integer", "float"):
        return df.withColumn(out, F.col(target).cast("double"))
    codes = label_mapping(df, target)
    return df.join(
        broadcast_if_small(codes.select(F.col("value").alias(target), F.col("code").cast("double").alias(out))),
        target, "left")
