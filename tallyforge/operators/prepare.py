"""Imputation, scaling, encoding and the fitted feature plan.

Every fit is an aggregate over the training rows whose result is as small as the schema (one
number per column, one short list per category); applying it is a projection that stays in
generated code. Only ordinal codes of large categories use a join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import vocab
from tallyforge.functions.columns import (
    categorical_columns, families, nan_to_null, numeric_columns, scalar_row,
)
from tallyforge.operators.counts import collect_facts, value_counts
from tallyforge.operators.persistence import StoredModel
from tallyforge.operators.quantiles import column_quantiles
from tallyforge.operators.roles import column_roles, label_mapping
from tallyforge.session import broadcast_if_small, materialise


def means(df: DataFrame, columns: Sequence[str]) -> dict:
    df = nan_to_null(df)
    row = scalar_row(df.agg(F.count("*"), *[F.avg(F.col(c).cast("double")).alias(c) for c in columns]))
    return {c: row[c] for c in columns}


def medians(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> dict:
    return {c: q[0] for c, q in column_quantiles(nan_to_null(df), columns, [0.5], approximate).items()}


def modes(df: DataFrame, columns: Sequence[str]) -> dict:
    """Most frequent value per column, the smallest on a tie."""
    return {c: f.mode for c, f in collect_facts(df, columns, digest=False).items()} if columns else {}


def fill(df: DataFrame, values: dict) -> DataFrame:
    """Replaces nulls and NaN by one value per column; numbers become doubles."""
    df, out = nan_to_null(df), {}
    for c, v in values.items():
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            out[c] = F.coalesce(F.col(c).cast("double"), F.lit(float(v)))
        elif v is not None:
            out[c] = F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType))
    return df.withColumns(out) if out else df


def impute(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
           strategy: str = "mean", fit_on: DataFrame | None = None) -> DataFrame:
    base = fit_on if fit_on is not None else df
    values = (means if strategy == "mean" else medians)(base, numeric) if numeric else {}
    values.update(modes(base, categorical))
    return fill(df, values)


def impute_robust(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinities count as missing; medians fill the gaps, and 0 where a column has no value."""
    infinite = lambda c: F.abs(F.col(c).cast("double")) == F.lit(float("inf"))
    finite = df.withColumns({
        c: F.when(~infinite(c), F.nanvl(F.col(c).cast("double"), F.lit(None))) for c in columns})
    middle = medians(finite, columns)
    return fill(finite, {c: 0.0 if v is None else v for c, v in middle.items()})


def choose_scaler(df: DataFrame, columns: Sequence[str]) -> str:
    """Standard when the largest sample variance exceeds 1, min-max otherwise."""
    if not columns:
        return "standard"
    row = scalar_row(nan_to_null(df).agg(*[F.var_samp(F.col(c).cast("double")).alias(c) for c in columns]))
    largest = max((row[c] for c in columns if row[c] is not None), default=0.0)
    return "standard" if largest > 1 else "minmax"


@dataclass
class Scaler:
    """Shift and divisor per column."""

    kind: str
    shift: dict = field(default_factory=dict)
    scale: dict = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str], kind: str = "standard") -> "Scaler":
        """Population deviation or range; a constant column is divided by 1."""
        if not columns:
            return cls(kind)
        aggs = []
        for c in columns:
            x = F.col(c).cast("double")
            if kind == "standard":
                aggs += [F.avg(x).alias(f"a_{c}"), F.stddev_pop(x).alias(f"b_{c}")]
            else:
                aggs += [F.min(x).alias(f"a_{c}"), (F.max(x) - F.min(x)).alias(f"b_{c}")]
        row = scalar_row(nan_to_null(df).agg(*aggs))
        return cls(kind, {c: row[f"a_{c}"] or 0.0 for c in columns},
                   {c: row[f"b_{c}"] or 1.0 for c in columns})

    def expression(self, c: str, value: Column | None = None) -> Column:
        x = (F.col(c) if value is None else value).cast("double")
        return (x - F.lit(float(self.shift[c]))) / F.lit(float(self.scale[c]))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: self.expression(c) for c in self.shift})


# Levels of a category that become columns of their own; a larger one is encoded by codes.
MAX_LEVELS = 10_000


def levels(df: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct values of small categories; more than ``MAX_LEVELS`` are refused."""
    if not columns:
        return {}
    counts = materialise(value_counts(df, columns).filter("value IS NOT NULL"))
    many = counts.groupBy("column").agg(F.count("*").alias("k")).filter(F.col("k") > MAX_LEVELS).first()
    if many:
        raise ValueError(f"{many['column']} has {many['k']} levels, more than {MAX_LEVELS}: encode it by codes")
    rows = (
        counts.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("v")).collect()
    )
    found = {r["column"]: list(r["v"]) for r in rows}
    return {c: found.get(c, []) for c in columns}


def one_hot(column: str, values: Sequence[str]) -> list[Column]:
    """One 0/1 column per level; an unseen or missing value gives all zeros."""
    x = F.col(column).cast("string")
    return [F.coalesce((x == F.lit(v)).cast("double"), F.lit(0.0)) for v in values]


def ordinal(df: DataFrame, column: str, out: str, fit_on: DataFrame | None = None) -> DataFrame:
    """Sorted code of each value, -1 when it was not seen; no size is assumed for the codes."""
    codes = label_mapping(fit_on if fit_on is not None else df, column)
    codes = broadcast_if_small(codes.select(F.col("value").alias(column), F.col("code").alias("_code")))
    return (
        df.join(codes, column, "left")
        .withColumn(out, F.coalesce(F.col("_code"), F.lit(-1)).cast("double")).drop("_code")
    )


@dataclass(eq=False)
class FeaturePlan(StoredModel):
    """A fitted preparation: which columns become which features, with the fitted numbers.

    A stage like any fitted model, so that it is stored with the model it prepares for.
    """

    numeric: list[str]
    low_card: dict[str, list[str]]
    high_card: list[str]
    fills: dict
    scaler: Scaler
    dropped: list[str]
    codes: dict = field(default_factory=dict)

    def __post_init__(self):
        super().__init__()

    def contents(self, spark):
        facts = {"numeric": self.numeric, "low_card": self.low_card, "high_card": self.high_card, "fills": self.fills,
                 "dropped": self.dropped, "kind": self.scaler.kind, "shift": self.scaler.shift, "scale": self.scaler.scale}
        return facts, {f"codes_{i}": self.codes[c] for i, c in enumerate(self.high_card)}, {}

    @classmethod
    def restored(cls, facts, tables, models):
        scaler = Scaler(facts["kind"], facts["shift"], facts["scale"])
        codes = {c: tables[f"codes_{i}"] for i, c in enumerate(facts["high_card"])}
        return cls(facts["numeric"], facts["low_card"], facts["high_card"], facts["fills"], scaler, facts["dropped"], codes)

    @property
    def inputs(self) -> list[str]:
        """The columns it reads."""
        return [*self.numeric, *self.low_card, *self.high_card]

    @property
    def names(self) -> list[str]:
        hot = [f"{c}_{v}" for c, vs in self.low_card.items() for v in vs]
        return [*self.numeric, *hot, *self.high_card]

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        filled = fill(df, self.fills)
        parts = [self.scaler.expression(c) for c in self.numeric]
        for c, vs in self.low_card.items():
            parts += one_hot(c, vs)
        for c in self.high_card:
            codes = self.codes[c].select(F.col("value").alias(c), F.col("code").alias(f"_{c}_code"))
            filled = filled.join(broadcast_if_small(codes), c, "left")
            parts.append(F.coalesce(F.col(f"_{c}_code"), F.lit(-1)).cast("double"))
        with_features = filled.withColumn(out, array_to_vector(F.array(*parts)))
        return with_features.select(*df.columns, out)

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.transform(df)

    def summary(self, spark, removed: int = 0) -> DataFrame:
        rows = [
            ("dropped", len(self.dropped), ", ".join(self.dropped)),
            ("numeric", len(self.numeric), self.scaler.kind),
            ("one_hot", len(self.low_card), ", ".join(self.low_card)),
            ("ordinal", len(self.high_card), ", ".join(self.high_card)),
            ("features", len(self.names), ""),
            ("removed_test_rows", removed, ""),
        ]
        return spark.createDataFrame(rows, "item string, n int, detail string")


def fit_plan(train: DataFrame, numeric: Sequence[str], low_card: Sequence[str],
             high_card: Sequence[str] = (), dropped: Sequence[str] = (), center: str = "mean",
             scaler: str | None = None) -> FeaturePlan:
    numeric, low_card, high_card = list(numeric), list(low_card), list(high_card)
    if not (numeric or low_card or high_card):
        raise ValueError("no usable feature columns")
    fills = (means if center == "mean" else medians)(train, numeric) if numeric else {}
    fills = {c: 0.0 if v is None else v for c, v in fills.items()}
    fills.update(modes(train, low_card + high_card))
    filled = fill(train, fills)
    kind = scaler or choose_scaler(train, numeric)
    return FeaturePlan(
        numeric, levels(train, low_card), high_card, fills,
        Scaler.fit(filled, numeric, kind), list(dropped),
        {c: label_mapping(train, c) for c in high_card},
    )


class Preparation(Estimator):
    """``fit_plan`` as a pipeline stage: learns the plan from the rows that the pipeline is fitted on."""

    def __init__(self, numeric: Sequence[str], low_card: Sequence[str] = (), high_card: Sequence[str] = (),
                 center: str = "mean", scaler: str | None = None):
        super().__init__()
        self.numeric, self.low_card, self.high_card, self.center, self.scaler = numeric, low_card, high_card, center, scaler

    def _fit(self, df: DataFrame) -> FeaturePlan:
        return fit_plan(df, self.numeric, self.low_card, self.high_card, center=self.center, scaler=self.scaler)


def usable_general(df: DataFrame, target: str, key: str | None = None):
    """Column roles without ids, for the general preparation."""
    exclude = [c for c in (target, key) if c]
    return column_roles(df, exclude).without_ids()


def usable_churn(df: DataFrame, target: str, key: str | None = None) -> tuple[list, list, list]:
    """Numeric, categorical and dropped columns of the churn preparation.

    Dropped are strings of more than 100 values and names that hold "id" or "date".
    """
    exclude = [c for c in (target, key) if c]
    kind = families(df)
    strings = [c for c in df.columns if kind[c] == "string" and c not in exclude]
    facts = collect_facts(df, strings)
    dropped = [
        c for c in df.columns if c not in exclude and (
            (c in facts and facts[c].nunique > 100) or "id" in c.lower() or "date" in c.lower())
    ]
    keep = [*exclude, *dropped]
    return numeric_columns(df, keep), categorical_columns(df, keep), dropped


def clustering_plan(df: DataFrame, exclude: Sequence[str] = ()) -> FeaturePlan:
    """Standard scaling and one-hot over all rows; gaps are filled first.

    Categories are encoded up to the category limit; larger ones are dropped.
    """
    numeric, strings = numeric_columns(df, exclude), categorical_columns(df, exclude)
    facts = collect_facts(df, strings) if strings else {}
    small = [c for c in strings if facts[c].nunique <= vocab.CATEGORY_LIMIT]
    large = [c for c in strings if c not in small]
    return fit_plan(df, numeric, small, dropped=large, scaler="standard")


def drop_null_target(df: DataFrame, target: str) -> DataFrame:
    return df.filter(F.col(target).isNotNull())


def matrix_problems(df: DataFrame, column: str, width: int) -> DataFrame:
    """Counts of rows that break each rule for a numeric matrix held as arrays."""
    x = F.col(column)
    size = F.size(x)
    bad_value = lambda test: F.count_if(F.exists(x, test))
    counts = df.agg(
        F.count("*").alias("rows"),
        F.count_if(x.isNull()).alias("null_rows"),
        F.count_if(x.isNotNull() & (size != F.lit(width))).alias("wrong_width"),
        bad_value(lambda v: v.isNull()).alias("null_values"),
        bad_value(F.isnan).alias("nan_values"),
        bad_value(lambda v: F.abs(v) == F.lit(float("inf"))).alias("infinite_values"),
    )
    rules = ["null_rows", "wrong_width", "null_values", "nan_values", "infinite_values"]
    long = counts.unpivot(["rows"], rules, "rule", "violations")
    empty = counts.select(F.lit("no_rows").alias("rule"),
                          (F.col("rows") == 0).cast("bigint").alias("violations"))
    return long.select("rule", "violations").unionByName(empty).select(
        "rule", "violations", (F.col("violations") == 0).cast("int").alias("passed"))


def target_problems(df: DataFrame, target: str, task: str) -> DataFrame:
    """Rules for the target: present in every row, two classes, finite numbers."""
    y = F.col(target)
    facts = df.agg(
        F.count("*").alias("n"), F.count(y).alias("present"),
        F.min(y).alias("lo"), F.max(y).alias("hi"),
        F.count_if(F.isnan(y.cast("double")) | (F.abs(y.cast("double")) == F.lit(float("inf"))))
        .alias("odd"),
    )
    rules = {
        "target_present": (F.col("n") - F.col("present"), F.col("n") == F.col("present")),
    }
    if task == "classification":
        rules["two_classes"] = (F.lit(0).cast("bigint"), F.col("lo") != F.col("hi"))
    else:
        rules["finite"] = (F.col("odd"), F.col("odd") == 0)
    entries = F.array(*[
        F.struct(F.lit(r).alias("rule"), v.alias("violations"), ok.cast("int").alias("passed"))
        for r, (v, ok) in rules.items()])
    return facts.select(F.inline(entries))
