"""Delimited text in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions import vocab
from tallyforge.functions.columns import nan_to_null

_HEAD_BYTES = 2048
_HEAD_LINES = 5
_EXTRA = "_overflow"


def _head(spark: SparkSession, path: str) -> str:
    """First bytes of the first data file; only that file's head is used."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select("path").filter(~F.element_at(F.split("path", "/"), -1).startswith("_"))
        .orderBy("path").limit(1)
    )
    first = files.first()
    if first is None:
        raise ValueError(f"no data file under {path}")
    lines = spark.read.text(first.path).limit(_HEAD_LINES).collect()
    return "\n".join(r.value for r in lines)[:_HEAD_BYTES]


def detect_separator(spark: SparkSession, path: str) -> str:
    """The most frequent of comma, semicolon, tab and space in the first lines."""
    head = _head(spark, path)
    return max(vocab.SEPARATORS, key=lambda s: (head.count(s), -vocab.SEPARATORS.index(s)))


def infer_schema(spark: SparkSession, path: str, sep: str, multiline: bool = True) -> T.StructType:
    return (
        spark.read.option("header", True).option("inferSchema", True).option("sep", sep)
        .option("multiLine", multiline).option("escape", '"').option("preferDate", False).option("timestampType", "TIMESTAMP_NTZ").csv(path).schema
    )


def read_delimited(
    spark: SparkSession, path: str, sep: str | None = ",", schema: T.StructType | None = None,
    multiline: bool = True,
) -> DataFrame:
    """Reads a header file; rows with too many fields are skipped, short rows are filled.

    ``sep=None`` detects the separator. One more column than the header catches the surplus of
    over-long rows, which is how they are told apart without dropping short ones. Pass ``schema``
    to save the inference pass over large inputs. Quoted fields may hold line breaks, so a file is read
    by one task; ``multiline=False`` lets Spark split files of which it is known that they hold none.
    """
    sep = sep or detect_separator(spark, path)
    schema = schema or infer_schema(spark, path, sep, multiline)
    if not schema.fields:
        raise ValueError(f"{path} is empty")
    wide = T.StructType([*schema.fields, T.StructField(_EXTRA, T.StringType())])
    rows = (
        spark.read.schema(wide).option("header", True).option("sep", sep)
        .option("multiLine", multiline).option("escape", '"').option("mode", "PERMISSIVE").option("enforceSchema", True).csv(path)
    )
    return nan_to_null(rows.filter(F.col(_EXTRA).isNull()).drop(_EXTRA))


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    """Writes CSV parts with a header; vectors become one column per component."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.linalg import VectorUDT

    for f in df.schema.fields:
        if isinstance(f.dataType, VectorUDT):
            width = len(df.select(f.name).first()[0])
            parts = vector_to_array(F.col(f.name))
            df = df.select(
                *[c for c in df.columns if c != f.name],
                *[parts[i].alias(f"{f.name}_{i}") for i in range(width)])
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("sep", sep).csv(path)
