"""Collapsing an event table to one row per entity with a single shuffle."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import vocab
from tallyforge.functions.columns import days_between, families, scalar_row, timestamp_literal
from tallyforge.operators import roles
from tallyforge.operators.counts import collect_facts


def numeric_measures(column: str) -> list:
    x = F.col(column)
    return [
        F.avg(x).alias(f"{column}_mean"),
        F.coalesce(F.sum(x), F.lit(0)).alias(f"{column}_sum"),
        F.min(x).alias(f"{column}_min"),
        F.max(x).alias(f"{column}_max"),
        F.stddev_samp(x).alias(f"{column}_std"),
        F.count(x).alias(f"{column}_count"),
    ]


def category_measures(column: str) -> list:
    """Mode (smallest on a tie) and distinct count.

    Both keep the values seen per entity, at most 50 by the definition of a category, and merge
    before the shuffle. ``countDistinct`` would instead expand every row once per column.
    """
    x = F.col(column)
    return [
        F.mode(x, deterministic=True).alias(f"{column}_mode"),
        F.size(F.collect_set(x)).cast("bigint").alias(f"{column}_nunique"),
    ]


def datetime_measures(column: str, latest) -> list:
    x = F.col(column)
    return [
        F.min(x).alias(f"{column}_min"),
        F.max(x).alias(f"{column}_max"),
        days_between(timestamp_literal(latest), F.max(x)).alias(f"{column}_recency_days"),
        days_between(F.max(x), F.min(x)).alias(f"{column}_tenure_days"),
    ]


def target_by_entity(df: DataFrame, entity: str, target: str, nunique: int) -> DataFrame:
    """Any-positive for a two-valued target, otherwise the most frequent value.

    The mode of a target with many values is found from counts per (entity, value), so the rows
    of one large entity are never gathered.
    """
    known = df.filter(F.col(entity).isNotNull())
    if nunique <= 2:
        return known.groupBy(entity).agg(F.max(target).alias(target))
    counts = known.groupBy(entity, target).agg(F.count("*").alias("_n"))
    best = F.min(F.when(F.col(target).isNotNull(),
                        F.struct((-F.col("_n")).alias("neg"), F.col(target).alias("value"))))
    return counts.groupBy(entity).agg(best.alias("_best")).select(
        entity, F.col("_best.value").alias(target))


@dataclass
class EntityResult:
    table: DataFrame
    entity: str | None
    aggregated: bool
    rules: list[tuple[str, str]] = field(default_factory=list)

    def report(self) -> DataFrame:
        return self.table.sparkSession.createDataFrame(self.rules, "column string, rule string")


def aggregate_entities(
    df: DataFrame, target: str | None = None, entity: str | None = None,
) -> EntityResult:
    """Finds the entity key and, if it repeats, aggregates every usable column per entity."""
    if entity is not None and entity not in df.columns:
        raise ValueError(f"no column {entity!r}")
    facts = collect_facts(df)  # the one pass over all columns that every decision below uses
    dates = roles.detect_datetime_columns(df, exclude=[c for c in (entity, target) if c])
    if entity is None:
        entity = roles.detect_entity_column(df, target, facts, dates)
    if entity is None or facts[entity].n_rows < vocab.ENTITY_MIN_ROWS * max(1, facts[entity].nunique):
        return EntityResult(df, entity, False)

    fixed = [c for c in (entity, target) if c]
    dates = [c for c in dates if c not in fixed]
    df = roles.coerce_datetimes(df, dates)
    kind = families(df)
    others = [c for c in df.columns if c not in fixed and c not in dates]
    numeric = [c for c in others if kind[c] in ("integer", "float", "boolean")]
    strings = [c for c in others if kind[c] == "string"]
    categories = [c for c in strings if facts[c].nunique <= vocab.CATEGORY_LIMIT]
    skipped = [c for c in others if c not in numeric and c not in categories]

    measures, rules = [], []
    for c in numeric:
        if kind[c] == "boolean":
            df = df.withColumn(c, F.col(c).cast("int"))
        measures += numeric_measures(c)
        rules.append((c, "numeric: mean, sum, min, max, std, count"))
    for c in categories:
        measures += category_measures(c)
        rules.append((c, "category: mode, nunique"))
    known = df.filter(F.col(entity).isNotNull())
    if dates:
        # the reference point is a scan of the date columns only
        latest = scalar_row(known.agg(*[F.max(c).alias(c) for c in dates]))
        for c in dates:
            measures += datetime_measures(c, latest[c])
            rules.append((c, "datetime: min, max, recency_days, tenure_days"))
    two_valued = bool(target) and facts[target].nunique <= 2
    if target:
        rules.append((target, "target: any positive" if two_valued else "target: mode"))
        if two_valued:
            measures.append(F.max(target).alias(target))
    rules += [(c, "skipped: many distinct values or unsupported type") for c in skipped]

    table = (
        known.groupBy(entity).agg(*measures) if measures else known.select(entity).distinct()
    )
    if target and not two_valued:
        labels = target_by_entity(df, entity, target, facts[target].nunique)
        table = table.join(labels, entity, "left")
    return EntityResult(table, entity, True, rules)
