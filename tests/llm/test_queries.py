"""The registered queries against their SQL and against brute force on the smallest tables."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm.queries import ORACLES, QUERIES
from tests.conftest import FOLDER
from tests.llm import cases
from tests.parity import compare, connect


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_sql(spark, key):
    assert compare(QUERIES[key](spark, FOLDER), connect(FOLDER), ORACLES[key]) == ""


def test_all_operators():
    assert sorted(int(re.match(r"op(\d+)_", k).group(1)) for k in QUERIES) == list(range(1, 14))


def pairs(tables):
    return [tuple(r) for r in tables.documents.select("doc_id", "text").collect()]


def test_components(spark, tables):
    out = QUERIES["op4_jaccard"](spark, FOLDER)
    assert cases.ordered(out.select("doc_id", "n_shingles", "component_id").collect()) == cases.ordered(cases.components(pairs(tables)))


def test_repeats(spark, tables):
    out = QUERIES["op5_repeats"](spark, FOLDER)
    assert cases.ordered(out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) \
        == cases.ordered(cases.repeats(pairs(tables)))


def test_held_out_accuracy(spark, tables):
    truth = tables.documents.select("doc_id", "lang")
    right = QUERIES["op1_language"](spark, FOLDER).join(truth, "doc_id").filter("held_out").select(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.95
    marked = QUERIES["op9_quality"](spark, FOLDER).join(tables.labels, "doc_id").filter("held_out")
    assert marked.select(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] >= 0.9


@pytest.mark.parametrize("key", ["op6_secrets", "op7_chat", "op8_personal"])
def test_native_queries_run_no_python(spark, key):
    plan = QUERIES[key](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_pipeline(spark, tables):
    """Every stage against brute force on what the one before it kept."""
    stages = dict(corpus_pipeline.STAGES)
    docs = tables.documents.withColumn("extra", F.lit("x"))
    scored = {r["doc_id"]: r["predicted"] for r in QUERIES["op9_quality"](spark, FOLDER).collect()}
    first = corpus_pipeline.stored(stages["quality"](spark, docs, FOLDER), "test")
    assert first.columns == docs.columns
    assert {r["doc_id"] for r in first.collect()} == {d for d, p in scored.items() if p}
    second = corpus_pipeline.stored(stages["exact_dedup"](spark, first, FOLDER), "test")
    largest = {}
    for r in first.collect():
        largest[r["text"]] = max(largest.get(r["text"], -1), r["doc_id"])
    assert {r["doc_id"] for r in second.collect()} == set(largest.values())
    third = corpus_pipeline.stored(stages["near_dedup"](spark, second, FOLDER), "test")
    rows = [(r["doc_id"], r["text"]) for r in second.collect()]
    assert {r["doc_id"] for r in third.collect()} == {c for _, _, c in cases.components(rows)}
    fourth = corpus_pipeline.stored(stages["decontaminate"](spark, third, FOLDER), "test")
    rows = [(r["doc_id"], r["text"]) for r in third.collect()]
    items = [tuple(r) for r in tables.benchmark.select("item_id", "text").collect()]
    assert fourth.columns == docs.columns
    assert {r["doc_id"] for r in fourth.collect()} == {r[0] for r in cases.contaminated(rows, items) if not r[-1]}
    packed = stages["pack"](spark, fourth, FOLDER)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in fourth.collect()}


@pytest.mark.parametrize("stage", ["quality", "exact_dedup", "near_dedup", "decontaminate"])
def test_stages_on_odd_documents(spark, stage):
    docs = spark.createDataFrame(cases.documents(), cases.SCHEMA)
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, FOLDER)
    assert out.columns == docs.columns
    # the rows without an id are copies of others, so only the exact stage drops them
    assert out.filter("doc_id is null").count() == (0 if stage == "exact_dedup" else 2)
    assert dict(corpus_pipeline.STAGES)[stage](spark, docs.limit(0), FOLDER).count() == 0


def test_disclosure_sql_finds_the_same_terms(spark, tmp_path):
    """The test tables hold no revealing term, so the SQL of operator 8 is also held to planted ones."""
    import numpy as np
    rng = np.random.default_rng(0)
    filler = ["lorem", "ipsum", "dolor", "sit", "amet", "elit", "sed", "quia"]
    rows = [(i, " ".join(rng.choice(filler, 30))) for i in range(900)]
    rows += [(1000 + i, f"{' '.join(rng.choice(filler, 4))} Zaphöd writes to z@hart.org {' '.join(rng.choice(filler, 4))}") for i in range(4)]
    rows += [(3000 + i, rows[900][1]) for i in range(50)]  # copies make no term less revealing
    rows += [(2000, "Ask Zaphöd, not Zaphödia; Zaphöd!"), (2001, "4111 1111 1111 1111 or 1.2.3.400"), (2002, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    out = QUERIES["op8_personal"](spark, str(tmp_path))
    assert out.filter("spans LIKE '%term:%'").count() == 55
    assert compare(out, con, ORACLES["op8_personal"]) == ""


def test_near_dedup_keeps_the_other_text_of_an_id(spark):
    """One text of id 7 is a near copy of id 1; the other one is like nothing else and stays."""
    words = [f"word{i}" for i in range(60)]
    clean = " ".join(f"clean{i}" for i in range(30))
    rows = [(1, " ".join(words)), (7, " ".join(words + ["more"])), (7, clean), (None, " ".join(words + ["less"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.near_dedup(spark, docs, FOLDER).collect()
    assert sorted(map(tuple, out), key=str) == sorted([rows[0], rows[2], rows[3]], key=str)


def test_near_dedup_of_one_id(spark):
    """Near copies that share an id: one of them stays; a clean text of that id stays as well."""
    words = [f"word{i}" for i in range(60)]
    rows = [(7, " ".join(words)), (7, " ".join(words + ["more"])), (7, " ".join(f"clean{i}" for i in range(30))), (9, " ".join(words + ["less"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(map(tuple, corpus_pipeline.near_dedup(spark, docs, FOLDER).collect()))
    assert len(out) == 2 and rows[2] in out and all(r[0] == 7 for r in out)


def test_quality_stage_keeps_a_column_of_its_own_score_name(spark, tables):
    docs = tables.documents.withColumn("stage_score", F.lit("mine"))
    out = corpus_pipeline.quality(spark, docs, FOLDER)
    assert out.columns == docs.columns and {r.stage_score for r in out.select("stage_score").distinct().collect()} == {"mine"}
