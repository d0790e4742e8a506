"""A corpus from raw documents to packed training sequences, one operator a stage.

Every stage reads the rows its predecessor kept; all but the last return the columns of documents.
Rows that a stage has no ground to reject stay: null and empty texts count as empty, null ids and
repeated rows are documents like others, extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import combination_prefix, content_sort, neighbour_quality, window_packing, wu_manber
from tallyforge.llm.common import held_out, short_batches, stored, table
from tallyforge.llm.queries import QUALITY_THRESHOLD, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour vote accepts; the vote learns from the labelled documents of the
    raw table that are not held out."""
    labels = table(spark, sf_dir, "labels").filter(~held_out("doc_id"))
    model = neighbour_quality.learn_quality(table(spark, sf_dir, "documents"), labels)
    name = "stage_score"
    while name in {c.lower() for c in docs.columns}:  # a column of the documents stays what it is
        name += "_"
    scored = neighbour_quality.score_quality(docs, model, score_col=name)
    return scored.filter(F.col(name) >= QUALITY_THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    short_batches(spark)
    return content_sort.distinct_texts(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by shingle similarity, the one with the smallest id.

    Documents without words and documents without an id are in no group and stay. An id may stand at
    different texts, so rows are known by id and text; of near copies that share the smallest id, the
    text with the smallest hash stays.
    """
    short_batches(spark)
    row = F.when(docs["doc_id"].isNotNull(), F.struct(docs["doc_id"], F.xxhash64(docs["text"]).alias("text_key")))
    groups = combination_prefix.jaccard_components(docs.select(row.alias("row"), "text"), id_col="row")
    dropped = groups.filter("component_id <> row").select(F.col("row").alias("dropped_row")).distinct()
    return docs.join(dropped, row == dropped["dropped_row"], "left_anti").select(*[docs[c] for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return wu_manber.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences."""
    short_batches(spark)
    return window_packing.pack(docs, tokenizer_path())


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("decontaminate", decontaminate), ("pack", pack)]

#: No stage but the exact ones can be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
