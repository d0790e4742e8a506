"""Exact dedup by content sort.

Sampled splitters range-partition the texts, each partition is sorted externally, neighbours are
compared in full, and runs that go on in the next partition are joined by one row per partition, after
a full comparison of the texts at both sides of the border.
The sort key is the text's first characters, then its SHA-256, then the id: the splitters that Spark
samples stay short however long the texts are, equal texts are neighbours, and ties by id spread a
large group of equal texts over partitions.

Defined results: null text counts as empty, and all empty texts are equal; a null id sorts as the
smallest id; of rows that repeat both id and text one is kept; an empty table gives no rows; other
columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.common import named_columns, numbered_columns, stored

#: Leading characters that take part in the sort key.
KEY_CHARS = 32

_ADDED = [T.StructField("run_part", T.IntegerType()), T.StructField("run_index", T.LongType()),
          T.StructField("run_head", T.BooleanType()), T.StructField("run_sha256", T.StringType()),
          T.StructField("run_first", T.StringType()), T.StructField("run_last", T.StringType())]


def sorted_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """All rows with the number of their run of equal texts inside their sorted partition; the first and
    the last row of a partition also have their text, in ``run_first`` and ``run_last``."""
    content = F.coalesce(F.col(text_col), F.lit(""))
    keyed = df.withColumn("run_sha256", F.sha2(content.cast("binary"), 256))
    order = [F.substring(content, 1, KEY_CHARS).asc(), F.col("run_sha256").asc(), F.col(id_col).desc()]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    names = [c for c in df.columns if keep_text or c != text_col]
    schema = T.StructType([df.schema[c] for c in names] + _ADDED)

    def runs(batches):
        part, index, last, held = TaskContext.get().partitionId(), -1, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(batch.schema.get_field_index(text_col)).fill_null("")
            same = pa.concat_arrays([pa.array([last is not None and texts[0].as_py() == last]),
                                     pc.equal(texts[1:], texts[:-1])]).to_pylist()
            indices = []
            for equal in same:
                index += not equal
                indices.append(index)
            opens = [texts[0].as_py() if last is None else None] + [None] * (len(same) - 1)
            last = texts[len(texts) - 1].as_py()
            columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
            columns += [pa.array([part] * len(same), pa.int32()), pa.array(indices, pa.int64()),
                        pa.array([not s for s in same]), batch.column(batch.schema.get_field_index("run_sha256")),
                        pa.array(opens, pa.string())]
            if held:  # one batch stays back, as only the end of the partition tells its last row
                yield ended(held, None)
            held = columns
        if held:
            yield ended(held, last)

    def ended(columns, text):
        closes = pa.array([None] * (len(columns[-1]) - 1) + [text], pa.string())
        return pa.RecordBatch.from_arrays([*columns, closes], schema.fieldNames())

    return ordered.mapInArrow(runs, schema)


def _continued(runs: DataFrame) -> DataFrame:
    """Per partition whose first run goes on from an earlier one: where that run began.

    One row per partition, so the ordered windows have as many rows as there are partitions, and no
    texts; those at the borders are compared in a join.
    """
    parts = runs.groupBy("run_part").agg(
        F.max("run_index").alias("last"), F.min_by("run_sha256", "run_index").alias("first_sha"),
        F.max_by("run_sha256", "run_index").alias("last_sha"))
    order = Window.orderBy("run_part")
    before = parts.withColumns({"before": F.lag("run_part").over(order), "alike": F.col("first_sha") == F.lag("last_sha").over(order)})
    opens = runs.filter("run_first is not null").select("run_part", "run_first")
    closes = runs.filter("run_last is not null").select(F.col("run_part").alias("before"), "run_last")
    borders = before.filter("alike").select("run_part", "before").join(opens, "run_part").join(closes, "before")
    equal = borders.filter("run_first = run_last").select("run_part", F.lit(True).alias("equal"))
    linked = parts.join(equal, "run_part", "left").withColumn("goes_on", F.coalesce("equal", F.lit(False)))
    began = F.when(~(F.col("goes_on") & (F.col("last") == 0)), F.struct("run_part", F.col("last").alias("run_index")))
    before = F.last(began, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (linked.withColumn("began", before).filter("goes_on")
            .select("run_part", F.col("began.run_part").alias("from_part"), F.col("began.run_index").alias("from_index")))


def global_runs(runs: DataFrame) -> DataFrame:
    """``run_part``/``run_index`` replaced by those where the run began, ``run_head`` true only there."""
    # at most one row per partition of the sort, so the broadcast is bounded by the partition count
    link = F.broadcast(_continued(runs))
    moved = (F.col("run_index") == 0) & F.col("from_part").isNotNull()
    return runs.join(link, "run_part", "left").withColumns({
        "run_head": F.col("run_head") & ~moved,
        "run_part": F.when(moved, F.col("from_part")).otherwise(F.col("run_part")),
        "run_index": F.when(moved, F.col("from_index")).otherwise(F.col("run_index")),
    }).drop("from_part", "from_index")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Of equal texts the row with the largest id stays.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    runs = global_runs(stored(sorted_runs(rows, "id"), "sorted-runs"))
    sizes = runs.groupBy("run_part", "run_index").agg(F.count("*").alias("group_size"), F.max("id").alias("keep_id"))
    groups = sizes.filter("group_size > 1")
    return runs.join(groups, ["run_part", "run_index"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("run_head").alias("kept"), F.col("run_sha256").alias("text_sha256"))


def distinct_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    rows, at = numbered_columns(df), df.columns.index
    runs = global_runs(stored(sorted_runs(rows, f"c{at(id_col)}", f"c{at(text_col)}", keep_text=True), "sorted-rows"))
    return named_columns(runs.filter("run_head"), df.columns)
