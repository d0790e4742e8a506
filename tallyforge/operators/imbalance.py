"""Diagnosing and correcting class imbalance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.hashing import hash_bucket, hash_unit
from tallyforge.operators.nearest import nearest
from tallyforge.operators.splits import class_counts, smallest_by_hash
from tallyforge.session import materialise


def diagnose(df: DataFrame, label: str) -> DataFrame:
    """Counts and rate of a 0/1 label, and how severe the imbalance is."""
    counts = df.agg(F.count("*").alias("total"), F.sum(F.col(label)).cast("bigint").alias("positive"))
    retained = F.col("total") - F.col("positive")
    ratio = F.col("positive") / F.greatest(retained, F.lit(1)).cast("double")
    level = F.when(ratio < 0.15, "severe").when(ratio < 0.30, "moderate").otherwise("acceptable")
    rate = F.try_divide(F.col("positive") * 100.0, F.col("total"))
    return counts.select(
        "total", "positive", retained.alias("negative"), F.round(rate, 4).alias("rate_pct"),
        F.round(ratio, 6).alias("ratio"), level.alias("imbalance"))


def balanced_weights(df: DataFrame, label: str) -> dict:
    """n / (k * n_c) per class."""
    counts = class_counts(df, label)
    total = sum(counts.values())
    return {c: total / (len(counts) * n) for c, n in counts.items()}


def weight_column(weights: dict, label: str) -> Column:
    return F.coalesce(*[F.when(F.col(label) == F.lit(c), F.lit(float(w)))
                        for c, w in weights.items()])


def undersample(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Every class reduced to the size of the smallest, without replacement."""
    counts = class_counts(df, label)
    least = min(counts.values())
    chosen = smallest_by_hash(df, key, label, {c: least for c in counts}, counts, seed)
    return df.filter(chosen)


def _between(near: DataFrame, minority: DataFrame, quota: DataFrame, key: str, features: str,
             k: int, seed: int) -> DataFrame:
    """New rows on the segment from a minority row to one of its ``k`` neighbours.

    ``quota`` gives the number of new rows per minority row; which neighbour and how far along
    the way is a hash of the row key and the copy number.
    """
    base = minority.select(F.col(key).cast("bigint").alias("query"), F.col(features).cast("array<double>").alias("x"))
    copies = base.join(quota, "query").filter("copies > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    tag = F.concat_ws("/", "query", "copy")
    drawn = copies.withColumns({
        "rank": (hash_bucket(tag, f"{seed}n", k) + 1).cast("int"), "gap": hash_unit(tag, f"{seed}g")})
    linked = drawn.join(near.select("query", "rank", "neighbour"), ["query", "rank"])
    other = base.select(F.col("query").alias("neighbour"), F.col("x").alias("y"))
    step = F.zip_with("x", "y", lambda a, b: b - a)
    return linked.join(other, "neighbour").select(
        F.col("query").alias("source"), "neighbour", "copy",
        F.zip_with("x", step, lambda a, s: a + s * F.col("gap")).alias(features))


def _minority(df: DataFrame, label: str):
    counts = class_counts(df, label)
    least = min(counts, key=lambda c: (counts[c], c))
    return least, counts[least], max(counts.values())


def smote(df: DataFrame, key: str = "key", label: str = "label", features: str = "features",
          k: int = 5, seed: int = 42) -> DataFrame:
    """Synthetic minority rows that bring the smallest class up to the largest.

    The missing rows are dealt out evenly; the remainder goes to the rows with the smallest hash.
    """
    least, have, want = _minority(df, label)
    minority = df.filter(F.col(label) == F.lit(least))
    k = min(k, have - 1)
    near = nearest(minority, k, key=key, features=features)
    share, rest = divmod(want - have, have)
    extra = smallest_by_hash(minority, key, label, {least: rest}, {least: have}, seed)
    quota = minority.select(F.col(key).cast("bigint").alias("query"), (F.lit(share) + extra.cast("int")).alias("copies"))
    return _between(near, minority, quota, key, features, k, seed).withColumn(label, F.lit(least))


def adasyn(df: DataFrame, key: str = "key", label: str = "label", features: str = "features",
           k: int = 5, seed: int = 42) -> DataFrame:
    """Like SMOTE, with more new rows where more of the ``k`` neighbours are of other classes."""
    least, have, want = _minority(df, label)
    minority = df.filter(F.col(label) == F.lit(least))
    around = nearest(df, k, queries=minority, key=key, features=features, skip_self=True)
    kinds = df.select(F.col(key).cast("bigint").alias("neighbour"), (F.col(label) != F.lit(least)).cast("int").alias("foreign"))
    hard = materialise(around.join(kinds, "neighbour").groupBy("query").agg(F.avg("foreign").alias("share")))
    total = hard.agg(F.sum("share").alias("s")).first().s
    if not total:
        raise ValueError("no minority row has a neighbour of another class")
    copies = F.round(F.col("share") / F.lit(total) * F.lit(want - have)).cast("bigint")
    quota = hard.select("query", copies.alias("copies"))
    k = min(k, have - 1)
    near = nearest(minority, k, key=key, features=features)
    return _between(near, minority, quota, key, features, k, seed).withColumn(label, F.lit(least))


def resample(df: DataFrame, synthetic: DataFrame, label: str = "label", features: str = "features") -> DataFrame:
    """Original and synthetic rows together, features and label only."""
    return df.select(F.col(features).cast("array<double>").alias(features), label).unionByName(
        synthetic.select(features, F.col(label).cast(df.schema[label].dataType).alias(label)))
