"""Feature selection and construction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.columns import nan_to_null, numeric_columns, scalar_row, seconds_between
from tallyforge.operators.counts import collect_facts
from tallyforge.operators.ordering import neighbourhood
from tallyforge.operators.prepare import impute_robust


def judge_numeric(df: DataFrame, exclude: Sequence[str] = (), limit: int | None = None) -> list[dict]:
    """Why each numeric column is kept or dropped; kept ones ranked by population variance."""
    df = nan_to_null(df)
    columns = numeric_columns(df, exclude)
    facts = collect_facts(df, columns)
    spread = scalar_row(df.agg(
        F.count("*"), *[F.var_pop(F.col(c).cast("double")).alias(c) for c in columns]))
    out = []
    for position, c in enumerate(columns):
        f = facts[c]
        present = f.n_rows - f.n_missing
        unique = f.nunique / max(1, present)
        common = f.mode_count / max(1, present)
        rules = {  # the first that holds gives the reason
            "all_missing": present == 0,
            "id_like": unique > 0.995 and f.nunique > min(100, max(20, present // 5)),
            "constant": f.nunique <= 1,
            "near_constant": common >= 0.995,
        }
        status = next((reason for reason, holds in rules.items() if holds), "kept")
        out.append({"column": c, "status": status, "variance": spread[c], "position": position})
    kept = sorted((r for r in out if r["status"] == "kept"),
                  key=lambda r: (-r["variance"], r["position"]))
    for rank, r in enumerate(kept):
        r["rank"] = rank
        if limit is not None and rank >= limit:
            r["status"] = "over_budget"
    return out


def select_numeric(df: DataFrame, exclude: Sequence[str] = (), limit: int | None = None) -> list[str]:
    kept = [r for r in judge_numeric(df, exclude, limit) if r["status"] == "kept"]
    return [r["column"] for r in sorted(kept, key=lambda r: r["rank"])]


def judgement_table(df: DataFrame, exclude: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    rows = [(r["column"], r["status"], None if r["variance"] is None else float(r["variance"]),
             r.get("rank", -1)) for r in judge_numeric(df, exclude, limit)]
    return df.sparkSession.createDataFrame(
        rows, "column string, status string, variance double, rank int")


def row_statistics(columns: Sequence[str]) -> dict[str, Column]:
    """Statistics across the columns of one row."""
    xs = [F.col(c).cast("double") for c in columns]
    n = F.lit(float(len(xs)))
    total = lambda parts: sum(parts[1:], parts[0])
    mean = total(xs) / n
    return {
        "row_mean": mean,
        "row_std": F.sqrt(total([(x - mean) * (x - mean) for x in xs]) / n),
        "row_min": F.least(*xs) if len(xs) > 1 else xs[0],
        "row_max": F.greatest(*xs) if len(xs) > 1 else xs[0],
        "row_abs_mean": total([F.abs(x) for x in xs]) / n,
        "row_l2_norm": F.sqrt(total([x * x for x in xs])),
    }


def tabular_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Imputed columns with their row statistics."""
    columns = list(columns)
    return impute_robust(df, columns).withColumns(row_statistics(columns))


def timeseries_features(df: DataFrame, time: str, key: str, columns: Sequence[str],
                        window: int = 12) -> tuple[DataFrame, list[str]]:
    """Lag, difference and rolling moments along the time axis (no imputation yet).

    The axis runs over the whole table; equal times are ordered by the key. Rows without a time have
    no place on it and are not returned.
    """
    base = list(columns)
    timed = df.filter(F.col(time).isNotNull())
    made: dict = {}
    for c in base:
        x = F.col(c).cast("double")
        span = lambda w: w.rowsBetween(-(window - 1), 0)
        made[f"{c}_lag1"] = lambda w, x=x: F.lag(x).over(w)
        made[f"{c}_diff1"] = lambda w, x=x: x - F.lag(x).over(w)
        made[f"{c}_roll_mean"] = lambda w, x=x: F.when(
            F.count(x).over(span(w)) >= 2, F.avg(x).over(span(w)))
        made[f"{c}_roll_std"] = lambda w, x=x: F.stddev_samp(x).over(span(w))
    made["time_delta_seconds"] = lambda w: seconds_between(F.col(time), F.lag(time).over(w))
    out = neighbourhood(timed, [time, key], window, made)
    return out, [*base, *made]


def widest(df: DataFrame, columns: Sequence[str], k: int) -> list[str]:
    """The k columns with the largest sample variance."""
    row = scalar_row(df.agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in columns]))
    order = sorted(columns, key=lambda c: (-(row[c] or 0.0), list(columns).index(c)))
    return order[:k]


def project(df: DataFrame, features: str = "features", k: int = 2) -> tuple[DataFrame, list[float]]:
    """First ``k`` principal components as columns, and the explained shares.

    The vectors are centred first, and each component is signed so that its largest loading is
    positive. A single feature is padded with zeros.
    """
    head = df.select(Summarizer.mean(F.col(features)).alias("m"),
                     Summarizer.count(F.col(features)).alias("n")).first()
    middle = [float(v) for v in head.m]
    width = len(middle)
    centred = F.zip_with(vector_to_array(features), F.array(*[F.lit(v) for v in middle]),
                         lambda a, b: a - b)
    if width == 1:
        flat = {f"component_{i + 1}": centred[0] if i == 0 else F.lit(0.0) for i in range(k)}
        return df.withColumns(flat), [1.0] + [0.0] * (k - 1)
    k = min(k, width)
    ready = df.withColumn("_centred", array_to_vector(centred))
    model = PCA(k=k, inputCol="_centred", outputCol="_pcs").fit(ready)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, i]).argmax(), i] >= 0 else -1.0 for i in range(k)]
    parts = vector_to_array("_pcs")
    out = model.transform(ready).withColumns(
        {f"component_{i + 1}": parts[i] * F.lit(signs[i]) for i in range(k)})
    return out.drop("_centred", "_pcs"), [float(v) for v in model.explainedVariance]
