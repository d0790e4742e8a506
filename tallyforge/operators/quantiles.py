"""Exact interpolated quantiles of many groups without holding a group in one task.

``percentile`` keeps every distinct value of a group in the memory of one task. Here an
approximate sketch first brackets each quantile; everything below a bracket collapses to one
count per task and everything above is dropped, so only the few values around each quantile are
ranked, and they are ranked with the distributed running sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.operators.ordering import running_sums
from tallyforge.session import broadcast_if_small, materialise

# Sketch error is n / ACCURACY; the bracket is wider than that on both sides.
ACCURACY = 10_000
MARGIN = 5e-4
# Below this many values the bracket spans the whole group, as ranks and shares differ too much.
SMALL_GROUP = 20_000


def quantiles(
    df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float],
    approximate: bool = False,
) -> DataFrame:
    """Rows ``groups + (prob, quantile)`` over the non-null values of each group."""
    groups, probs = list(groups), [float(p) for p in probs]
    values = df.select(*groups, F.col(value).cast("double").alias("_x")).filter("_x IS NOT NULL")
    if approximate:
        rough = values.groupBy(*groups).agg(
            F.percentile_approx("_x", probs, ACCURACY).alias("_q"))
        pairs = F.arrays_zip(F.array(*[F.lit(p) for p in probs]).alias("prob"),
                             F.col("_q").alias("quantile"))
        return rough.select(*groups, F.inline(pairs).alias("prob", "quantile"))

    probs = sorted(probs)
    low = [max(0.0, p - MARGIN) for p in probs]
    high = [min(1.0, p + MARGIN) for p in probs]
    rough = values.groupBy(*groups).agg(
        F.count("*").alias("_n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"),
        F.percentile_approx("_x", low + high, ACCURACY).alias("_cut"),
    )
    small = F.col("_n") < SMALL_GROUP
    names = [(f"_lo{i}", f"_hi{i}") for i in range(len(probs))]
    bounds = {"_n": F.col("_n")}
    for i, (lo, hi) in enumerate(names):
        bounds[lo] = F.when(small, F.col("_min")).otherwise(F.col("_cut")[i])
        bounds[hi] = F.when(small, F.col("_max")).otherwise(F.col("_cut")[i + len(probs)])
    rough = rough.select(*groups, *[c.alias(n) for n, c in bounds.items()])
    if groups:
        rough = broadcast_if_small(materialise(rough))
    joined = values.join(rough, groups) if groups else _with_row(values, rough)
    # a value in a bracket stays; one between brackets is lifted to the next bracket and only counts
    x = F.col("_x")
    inside = F.lit(False)
    lifted = F.lit(None).cast("double")
    for lo, hi in reversed(names):
        inside = inside | ((x >= F.col(lo)) & (x <= F.col(hi)))
        lifted = F.when(x < F.col(lo), F.col(lo)).otherwise(lifted)
    spot_value = F.when(inside, x).otherwise(lifted)
    counts = (
        joined.select(*groups, "_n", spot_value.alias("_x"), inside.alias("_in"))
        .filter("_x IS NOT NULL")
        .groupBy(*groups, "_x", "_in").agg(F.first("_n").alias("_n"), F.count("*").alias("_c"))
    )
    # lifted values rank below the bracket they were lifted to; False sorts before True
    ranked = running_sums(counts, [*groups, "_x", "_in"], {"_c": "_upto"})
    start = ranked.groupBy(*groups).agg(F.min(F.col("_upto") - F.col("_c")).alias("_base"))
    placed = ranked.join(start, groups) if groups else _with_row(ranked, start)
    begin = F.col("_upto") - F.col("_c") - F.col("_base")
    end = F.col("_upto") - F.col("_base")
    spots = [F.lit(p) * (F.col("_n") - 1) for p in probs]
    cover = lambda spot: (begin <= spot) & (spot < end)
    aggs = [F.first("_n").alias("_n")]
    for i, spot in enumerate(spots):
        aggs.append(F.max(F.when(cover(F.floor(spot)), x)).alias(f"_lo{i}"))
        aggs.append(F.max(F.when(cover(F.ceil(spot)), x)).alias(f"_hi{i}"))
    picked = placed.groupBy(*groups).agg(*aggs)
    entries = F.array(*[
        F.struct(
            F.lit(p).alias("prob"),
            (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (spot - F.floor(spot))).alias("quantile"))
        for i, (p, spot) in enumerate(zip(probs, spots))])
    return picked.select(*groups, F.inline(entries))


def _with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row table as literals."""
    row = one_row.first()
    kinds = {f.name: f.dataType for f in one_row.schema.fields}
    return df.withColumns({n: F.lit(row[n] if row else None).cast(k) for n, k in kinds.items()})


def column_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], approximate: bool = False,
) -> dict[str, list[float | None]]:
    """Quantiles of each column, collected: one row per column and probability."""
    columns = list(columns)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "column", "x")
    found = {(r["column"], r["prob"]): r["quantile"]
             for r in quantiles(long, ["column"], "x", probs, approximate).collect()}
    return {c: [found.get((c, float(p))) for p in probs] for c in columns}
