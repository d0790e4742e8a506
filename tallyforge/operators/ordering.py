"""Order over a whole table without one task seeing all of it.

A window with no partition key plans a single-partition exchange. Here the rows are range
partitioned on the ordering key, the partition each row landed in is written down by a reliable
checkpoint (a re-run of the range partitioner may cut elsewhere), and only one total per
partition is brought together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.session import materialise

_SLICE = "_slice"
# Rows per window block in ``neighbourhood``; large against any halo, small against a task.
BLOCK_ROWS = 100_000


def _order(keys: Sequence[str | Column]) -> list[Column]:
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def slices(df: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """The rows range partitioned on ``keys``; ``_slice`` rises with the order."""
    ranged = df.repartitionByRange(*_order(keys)).withColumn(_SLICE, F.spark_partition_id())
    return materialise(ranged)


def _before(sliced: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Sum of each total over all earlier slices; one row per slice, so safe to broadcast."""
    per_slice = sliced.groupBy(_SLICE).agg(*[c.alias(n) for n, c in totals.items()])
    rows = sorted(per_slice.collect(), key=lambda r: r[_SLICE])
    running = {n: 0 for n in totals}
    table = []
    for row in rows:
        table.append((row[_SLICE], *[running[n] for n in totals]))
        for n in totals:
            running[n] += row[n] or 0
    kinds = ", ".join(f"_before_{f.name} {f.dataType.simpleString()}"
                      for f in per_slice.schema.fields if f.name != _SLICE)
    typed = [
        (r[0], *[float(v) if "double" in k else v
                 for v, k in zip(r[1:], kinds.split(", "))]) for r in table
    ]
    offsets = sliced.sparkSession.createDataFrame(typed, f"{_SLICE} int, {kinds}")
    return F.broadcast(offsets)


def running_sums(df: DataFrame, keys: Sequence[str | Column], sums: dict[str, str]) -> DataFrame:
    """Adds running totals in the order of ``keys``: ``sums`` maps a column to its output.

    The keys must be unique; aggregate to one row per key first, which also removes hot keys.
    """
    sliced = slices(df, keys)
    offsets = _before(sliced, {c: F.sum(c) for c in sums})
    window = Window.partitionBy(_SLICE).orderBy(*_order(keys)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        sliced.join(offsets, _SLICE)
        .withColumns({out: F.sum(c).over(window) + F.col(f"_before_{c}")
                      for c, out in sums.items()})
        .drop(_SLICE, *[f"_before_{c}" for c in sums])
    )


def positions(df: DataFrame, keys: Sequence[str | Column], out: str = "position") -> DataFrame:
    """Adds the 0-based position of each row in the order of ``keys`` (unique keys)."""
    sliced = slices(df, keys)
    offsets = _before(sliced, {"n": F.count("*")})
    window = Window.partitionBy(_SLICE).orderBy(*_order(keys))
    return (
        sliced.join(offsets, _SLICE)
        .withColumn(out, (F.row_number().over(window) - 1 + F.col("_before_n")).cast("bigint"))
        .drop(_SLICE, "_before_n")
    )


def neighbourhood(
    df: DataFrame, keys: Sequence[str | Column], reach: int, columns: dict,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Window expressions that look at most ``reach`` rows back along a global order.

    Rows are numbered, cut into equal blocks, and the last ``reach`` rows of each block are also
    sent to the next one, so every block is computed on its own and keeps its own rows only.
    ``columns`` maps an output name to a function of the window specification.
    """
    block_rows = max(block_rows, reach + 1)
    numbered = positions(df, keys, "_pos")
    block = F.floor(F.col("_pos") / F.lit(block_rows))
    at_end = F.col("_pos") % F.lit(block_rows) >= F.lit(block_rows - reach)
    homes = F.when(at_end, F.array(block, block + 1)).otherwise(F.array(block))
    spread = numbered.withColumn("_home", block).withColumn("_block", F.explode(homes))
    window = Window.partitionBy("_block").orderBy("_pos")
    return (
        spread.withColumns({name: make(window) for name, make in columns.items()})
        .filter(F.col("_home") == F.col("_block"))
        .drop("_home", "_block", "_pos")
    )
