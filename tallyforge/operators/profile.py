"""Dataset profiling."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.columns import (
    dtype_family, nan_to_null, numeric_columns, scalar_columns, scalar_row,
)
from tallyforge.operators.counts import column_facts
from tallyforge.operators.quantiles import quantiles
from tallyforge.operators.roles import column_roles
from tallyforge.session import broadcast_if_small, materialise


def _missing(name: str):
    return F.count_if(F.col(name).isNull())


def row_digest(df: DataFrame):
    """256-bit digest of a row's values in their own types; nulls and field borders are marked, and
    times keep their microseconds."""
    parts = []
    for f in df.schema.fields:
        kind = dtype_family(f.dataType)
        text = F.to_json(F.struct(F.col(f.name))) if kind == "other" else F.col(f.name).cast("string")
        parts += [F.coalesce(F.length(text), F.lit(-1)).cast("string"), F.coalesce(text, F.lit(""))]
    return F.sha2(F.concat_ws(":", *parts), 256)


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells and share, fully duplicated rows.

    Copies are found by a digest of the row, so long texts never travel.
    """
    df = nan_to_null(df)
    width = len(df.columns)
    gaps = sum((F.col(c).isNull().cast("int") for c in df.columns), F.lit(0))
    distinct = df.select(row_digest(df).alias("_d"), gaps.alias("_gaps")).groupBy("_d").agg(
        F.count("*").alias("_n"), F.sum("_gaps").alias("_gaps"))
    totals = distinct.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum("_gaps"), F.lit(0)).alias("missing_cells"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"),
    )
    share = F.try_divide(F.col("missing_cells") * 100.0, F.col("n_rows") * F.lit(float(width)))
    return totals.select(
        "n_rows",
        F.lit(width).cast("bigint").alias("n_columns"),
        "missing_cells",
        F.round(F.coalesce(share, F.lit(0.0)), 4).alias("missing_pct"),
        "duplicate_rows",
    )


def missing_by_column(df: DataFrame, only_gaps: bool = True) -> DataFrame:
    """Missing count and share per column, largest first; NaN is missing."""
    df = nan_to_null(df)
    counts = df.agg(F.count("*").alias("_rows"), *[_missing(c).alias(c) for c in df.columns])
    long = counts.unpivot(["_rows"], list(df.columns), "column", "missing")
    out = long.select(
        "column",
        "missing",
        F.round(F.try_divide(F.col("missing") * 100.0, F.col("_rows")), 4).alias("missing_pct"),
    )
    if only_gaps:
        out = out.filter("missing > 0")
    return out.orderBy(F.desc("missing"), "column")


def cardinality(df: DataFrame, top: int | None = None, approximate: bool = False) -> DataFrame:
    """Distinct values per column, largest first. ``approximate`` trades exactness for one pass."""
    columns = scalar_columns(df)
    kinds = {c: dtype_family(df.schema[c].dataType) for c in columns}
    if approximate:
        wide = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns])
        counts = wide.unpivot([], columns, "column", "nunique")
    else:
        counts = column_facts(df, columns).select("column", "nunique")
    kind = F.coalesce(*[F.when(F.col("column") == c, F.lit(k)) for c, k in kinds.items()])
    out = counts.select("column", kind.alias("dtype"), "nunique").orderBy(F.desc("nunique"), "column")
    return out if top is None else out.limit(top)


def correlation_pairs(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair of numeric columns, each over its complete rows.

    Columns without gaps share their means, so their pairs need plain sums of centred products,
    which stay in generated code; only pairs with a gap use one correlation aggregate each.
    """
    df = nan_to_null(df)
    columns = list(columns or numeric_columns(df))
    if len(columns) < 2:
        raise ValueError("need at least two numeric columns")
    x = {c: F.col(c).cast("double") for c in columns}
    facts = scalar_row(df.agg(
        F.count("*").alias("n"), *[F.count(x[c]).alias(f"k{i}") for i, c in enumerate(columns)],
        *[F.avg(x[c]).alias(f"m{i}") for i, c in enumerate(columns)]))
    full = [c for i, c in enumerate(columns) if facts[f"k{i}"] == facts.n]
    centred = {c: x[c] - F.lit(facts[f"m{i}"]) for i, c in enumerate(columns) if c in full}
    pairs = list(combinations(columns, 2))
    aggs = [F.sum(centred[c] * centred[c]).alias(f"s_{c}") for c in full]
    for i, (a, b) in enumerate(pairs):
        both = a in centred and b in centred
        aggs.append((F.sum(centred[a] * centred[b]) if both else F.corr(x[a], x[b])).alias(f"p{i}"))
    wide = df.agg(*aggs)
    entries = []
    for i, (a, b) in enumerate(pairs):
        r = F.col(f"p{i}")
        if a in centred and b in centred:
            r = F.try_divide(r, F.sqrt(F.col(f"s_{a}")) * F.sqrt(F.col(f"s_{b}")))
        entries.append(F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), r.alias("r")))
    return wide.select(F.inline(F.array(*entries))).select(
        "column_a", "column_b", F.round("r", 4).alias("correlation"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between the smallest and the largest value; empty bins included."""
    values = nan_to_null(df.select(F.col(column).cast("double").alias("x"))).filter("x IS NOT NULL")
    edges = scalar_row(values.agg(F.min("x").alias("lo"), F.max("x").alias("hi")))
    spark = df.sparkSession
    if edges.lo is None:
        return spark.createDataFrame([], "bin int, bin_start double, bin_end double, n bigint")
    lo, hi = edges.lo, edges.hi
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    slot = F.least(F.floor((F.col("x") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    counts = values.groupBy(slot.alias("bin")).agg(F.count("*").alias("n"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        grid.join(F.broadcast(counts), "bin", "left")  # at most one row per bin
        .select(
            "bin",
            F.round(F.lit(lo) + F.col("bin") * F.lit(width), 6).alias("bin_start"),
            F.round(F.lit(lo) + (F.col("bin") + 1) * F.lit(width), 6).alias("bin_end"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def top_values(df: DataFrame, column: str, top: int = 20) -> DataFrame:
    """Most frequent values of one column."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("string").alias("value"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "value")
        .limit(top)
    )


def box_by_class(df: DataFrame, target: str, max_features: int | None = None) -> DataFrame:
    """Box-plot numbers of each numeric column per class.

    Whiskers are the most extreme values within 1.5 interquartile ranges of the box.
    """
    columns = numeric_columns(df, exclude=[target])[:max_features]
    long = (
        nan_to_null(df).select(F.col(target).cast("string").alias("class"),
                  *[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot(["class"], columns, "feature", "x")
        .filter("x IS NOT NULL AND class IS NOT NULL")
    )
    probs = [0.25, 0.5, 0.75]
    q = quantiles(long, ["class", "feature"], "x", probs).groupBy("class", "feature").agg(*[
        F.max(F.when(F.col("prob") == p, F.col("quantile"))).alias(n)
        for p, n in zip(probs, ["q1", "median", "q3"])
    ])
    spread = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("x").between(F.col("q1") - spread, F.col("q3") + spread)
    out = long.join(broadcast_if_small(materialise(q)), ["class", "feature"]).groupBy("class", "feature").agg(
        F.count("*").alias("n_rows"),
        F.min("x").alias("lowest"),
        F.first("q1").alias("q1"),
        F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.max("x").alias("highest"),
        F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )
    numbers = ("lowest", "q1", "median", "q3", "highest", "whisker_low", "whisker_high")
    return out.withColumns({c: F.round(c, 4) for c in numbers})


def positive_hint(df: DataFrame, target: str, words: Sequence[str]) -> DataFrame:
    """Share of rows whose target reads like a positive answer."""
    hit = F.lower(F.col(target).cast("string")).isin(*words)
    return df.agg(
        F.round(F.avg(F.coalesce(hit, F.lit(False)).cast("double")), 6).alias("positive_rate")
    )


def dataset_health(df: DataFrame) -> DataFrame:
    """The overview plus how many columns look like ids, small and large categories."""
    roles = column_roles(df)
    return overview(df).select(
        "*",
        F.lit(len(roles.ids)).cast("bigint").alias("id_like_columns"),
        F.lit(len(roles.low_card)).cast("bigint").alias("low_card_columns"),
        F.lit(len(roles.high_card)).cast("bigint").alias("high_card_columns"),
    )
