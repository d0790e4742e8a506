"""Distribution drift between two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.columns import nan_to_null, numeric_columns
from tallyforge.operators.ordering import running_sums
from tallyforge.session import materialise

BINS = 10
_EPS = 1e-8


def shared_numeric(reference: DataFrame, new: DataFrame) -> list[str]:
    theirs = set(numeric_columns(new))
    return [c for c in numeric_columns(reference) if c in theirs]


def value_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Counts of every value of every column, ``(feature, x, n)``: all that a later comparison needs
    to know of a reference, so it can be stored once."""
    columns = columns or numeric_columns(df)
    part = nan_to_null(df.select(*[F.col(c).cast("double").alias(c) for c in columns]))
    return part.unpivot([], columns, "feature", "x").filter("x IS NOT NULL").groupBy("feature", "x").agg(
        F.count("*").alias("n"))


def paired_profiles(reference: DataFrame, new: DataFrame) -> DataFrame:
    """Two profiles side by side: ``(feature, x, ref, cur)`` of the features that both have."""
    sides = [p.select("feature", "x", (F.col("n") * flag).alias("ref"), (F.col("n") * (1 - flag)).alias("cur"))
             for p, flag in ((reference, 1), (new, 0))]
    return sides[0].unionByName(sides[1]).groupBy("feature", "x").agg(
        F.sum("ref").cast("bigint").alias("ref"), F.sum("cur").cast("bigint").alias("cur"))


def paired_counts(reference: DataFrame, new: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Counts of every value of every shared column on both sides: ``(feature, x, ref, cur)``.

    Both drift statistics are read from this one table.
    """
    columns = columns or shared_numeric(reference, new)
    return paired_profiles(value_profile(reference, columns), value_profile(new, columns))


def _totals(counts: DataFrame) -> DataFrame:
    """One row per feature, as small as the schema."""
    return counts.groupBy("feature").agg(
        F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur"),
        F.min("x").alias("lo"), F.max("x").alias("hi"))


def psi(counts: DataFrame, bins: int = BINS) -> DataFrame:
    """Population stability index over equal-width bins of the joint range."""
    totals = F.broadcast(_totals(counts))
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    reached = [(F.col("x") >= F.col("lo") + step * F.lit(float(i))).cast("int") for i in range(1, bins)]
    binned = counts.join(totals, "feature").withColumn("bin", sum(reached[1:], reached[0]))
    filled = binned.groupBy("feature", "bin").agg(
        F.sum("ref").alias("r"), F.sum("cur").alias("c"),
        F.first("n_ref").alias("n_ref"), F.first("n_cur").alias("n_cur"))

    def share(n: Column, total: Column) -> Column:
        return (n + F.lit(_EPS)) / (total + F.lit(_EPS * bins))

    a, e = share(F.col("c"), F.col("n_cur")), share(F.col("r"), F.col("n_ref"))
    # a bin that is empty on both sides has the same tiny share only up to the totals
    n_ref, n_cur = F.max("n_ref"), F.max("n_cur")
    a0, e0 = share(F.lit(0.0), n_cur), share(F.lit(0.0), n_ref)
    gaps = (F.lit(bins) - F.count("*")) * (a0 - e0) * F.ln(a0 / e0)
    return filled.groupBy("feature").agg(
        F.round(F.abs(F.sum((a - e) * F.ln(a / e)) + gaps), 6).alias("psi"))


def kolmogorov_p(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sample p-value; none where a side has no values."""
    size = F.sqrt(F.try_divide(n * m, n + m))
    lam = (size + F.lit(0.12) + F.try_divide(F.lit(0.11), size)) * d
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(100)),
        lambda j: F.when(j % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(-2.0 * j * j * lam * lam))
    series = F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), series))
    return F.when(lam < 1e-3, F.lit(1.0)).when(lam.isNotNull(), bounded)


def ks(counts: DataFrame) -> DataFrame:
    """Largest gap between the two distribution functions, with its p-value; both are null where a side
    has no values."""
    ranked = running_sums(counts, ["feature", "x"], {"ref": "ref_upto", "cur": "cur_upto"})
    start = F.broadcast(ranked.groupBy("feature").agg(
        F.min(F.col("ref_upto") - F.col("ref")).alias("ref_base"),
        F.min(F.col("cur_upto") - F.col("cur")).alias("cur_base"),
        F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur")))
    below = lambda s: F.try_divide(F.col(f"{s}_upto") - F.col(f"{s}_base"), F.col(f"n_{s}").cast("double"))
    gaps = ranked.join(start, "feature").groupBy("feature").agg(
        F.max(F.abs(below("ref") - below("cur"))).alias("d"),
        F.first("n_ref").cast("double").alias("n"), F.first("n_cur").cast("double").alias("m"))
    return gaps.select(
        "feature", F.round("d", 6).alias("ks_stat"),
        F.round(kolmogorov_p(F.col("d"), F.col("n"), F.col("m")), 6).alias("p_value"),
        F.col("n").cast("bigint").alias("n_ref"), F.col("m").cast("bigint").alias("n_cur"))


def drift_report(reference: DataFrame, new: DataFrame) -> DataFrame:
    """PSI, KS and the drift level of every shared column with at least 5 values on each side."""
    return report_of(paired_counts(reference, new))


def report_of(counts: DataFrame) -> DataFrame:
    """The report from the counts of both sides, which are made once for all statistics."""
    counts = materialise(counts)
    both = ks(counts).join(psi(counts), "feature").filter("n_ref >= 5 AND n_cur >= 5")
    level = (
        F.when((F.col("psi") > 0.2) | (F.col("ks_stat") > 0.3), "Major")
        .when((F.col("psi") > 0.1) | (F.col("ks_stat") > 0.15), "Minor").otherwise("Stable"))
    return both.select("feature", F.round("ks_stat", 4).alias("ks_stat"), F.round("p_value", 4).alias("p_value"),
                       "psi", level.alias("level")).orderBy(F.desc("psi"), "feature")


def drift_levels(report: DataFrame) -> DataFrame:
    """Features per level and their names."""
    return report.groupBy("level").agg(
        F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("feature")), ", ").alias("features"))
