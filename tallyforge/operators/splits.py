"""Repeatable splits, folds and subsamples.

Membership is a function of the row key, so it does not change when rows move between tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.hashing import hash_bucket
from tallyforge.session import broadcast_if_small, materialise

_FINE = 1_000_000
_WORDS = 2 ** 32


def random_split(df: DataFrame, key: str, test_share: float = 0.2, seed: int = 42,
                 out: str = "is_test") -> DataFrame:
    """Flags about ``test_share`` of the rows as test rows."""
    chosen = hash_bucket(key, seed, _FINE) < F.lit(round(test_share * _FINE))
    return df.withColumn(out, chosen.cast("int"))


def class_counts(df: DataFrame, target: str) -> dict:
    """Rows per class; a classification target, so as small as its label set."""
    rows = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n"))
    return {r[target]: r["n"] for r in rows.collect()}


def smallest_by_hash(df: DataFrame, key: str, target: str, take: dict, counts: dict,
                     seed: int) -> Column:
    """Condition that holds for exactly ``take[c]`` rows of each class ``c``.

    They are the rows with the smallest hash of their key. The hash is uniform, so the border of
    a class is known up to a few standard errors; only the rows near it (about the square root
    of the class) are ranked. Everything else is decided by comparison with a literal, without
    sorting or gathering a class.
    """
    word = hash_bucket(key, seed, _WORDS)
    borders: dict = {}
    pending = {}
    for c, k in take.items():
        if k <= 0:
            borders[c] = F.lit(False)
        elif k >= counts[c]:
            borders[c] = F.lit(True)
        else:
            pending[c] = k
    width = 6.0
    while pending:
        low, high = {}, {}
        for c, k in pending.items():
            share, n = k / counts[c], counts[c]
            slack = width * (math.sqrt(share * (1 - share) / n) + 2.0 / n)
            low[c] = max(0, int((share - slack) * _WORDS))
            high[c] = min(_WORDS, int((share + slack) * _WORDS))
        pick = lambda table: F.coalesce(*[
            F.when(F.col(target) == F.lit(c), F.lit(v)) for c, v in table.items()])
        near = df.select(F.col(target).alias("c"), F.col(key).alias("k"), word.alias("w"),
                         pick(low).alias("lo"), pick(high).alias("hi")).filter("w <= hi")
        below = near.groupBy("c").agg(F.count_if(F.col("w") < F.col("lo")).alias("n")).collect()
        missing = {r.c: pending[r.c] - r.n for r in below}
        ranked = (
            near.filter("w >= lo")
            .withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("w", "k")))
            .filter(F.coalesce(*[F.when(F.col("c") == F.lit(c), F.lit(m)) for c, m in missing.items()])
                    == F.col("r"))
            .collect()  # one row per class
        )
        for r in ranked:
            borders[r.c] = (word < F.lit(r.w)) | ((word == F.lit(r.w)) & (F.col(key) <= F.lit(r.k)))
            pending.pop(r.c)
        width *= 4
    if not borders:
        return F.lit(False)
    chosen = F.coalesce(*[F.when(F.col(target) == F.lit(c), rule) for c, rule in borders.items()])
    return F.coalesce(chosen, F.lit(False))


def stratified_split(df: DataFrame, key: str, target: str, test_share: float = 0.2,
                     seed: int = 42, out: str = "is_test") -> DataFrame:
    """Flags the same share of every class as test rows, exact to one row."""
    counts = class_counts(df, target)
    take = {c: math.floor(n * test_share + 0.5) for c, n in counts.items()}
    chosen = smallest_by_hash(df, key, target, take, counts, seed)
    return df.withColumn(out, chosen.cast("int"))


def folds(df: DataFrame, key: str, count: int, target: str | None = None, seed: int = 42,
          out: str = "fold") -> DataFrame:
    """Fold 0..count-1 of each row; with a target every class is spread evenly.

    Borders between folds are found like the border of a stratified split, one per fold.
    """
    if target is None:
        return df.withColumn(out, hash_bucket(key, seed, count).cast("int"))
    counts = class_counts(df, target)
    fold = F.lit(0)
    for i in range(1, count):
        take = {c: math.floor(n * i / count + 0.5) for c, n in counts.items()}
        fold = fold + (~smallest_by_hash(df, key, target, take, counts, seed)).cast("int")
    return df.withColumn(out, fold.cast("int"))


def fold_count(option: str | int, task: str, n_rows: int, smallest_class: int,
               tuning: bool = False) -> int:
    """Folds to use; 0 when fewer than two are possible."""
    if option == "None":
        k = 0
    elif option in ("Auto", "auto"):
        k = min(10, smallest_class if task == "classification" else n_rows)
    else:
        k = int(option)
    if tuning:
        k = max(3, k)
    return k if k >= 2 else 0


def drop_unseen(train: DataFrame, test: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Test rows whose non-null categories all occur in the training rows; the known values are
    broadcast where they are small, so the test rows stay where they are."""
    columns = list(columns)
    if not columns:
        return test
    known = materialise(train.select(*[F.col(c).cast("string").alias(c) for c in columns])
                        .unpivot([], columns, "column", "value").filter("value IS NOT NULL").distinct())
    for c in columns:
        own = broadcast_if_small(known.filter(F.col("column") == c).select(F.col("value").alias("_known")))
        joined = test.join(own, F.col(c).cast("string") == F.col("_known"), "left")
        test = joined.filter(F.col("_known").isNotNull() | F.col(c).isNull()).drop("_known")
    return test
