"""Registered queries against DuckDB, and the pipeline stage by stage."""

import __spark_entry__ as entry_module
import corpus_pipeline
import pytest
from oracle_compare import connect, differences
from panelcast.llm.queries import QUERIES, SQL
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def con(medium):
    return connect(medium)


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry_module.queries())
    assert set(SQL) <= set(entry_module.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, medium, name):
    assert differences(QUERIES[name](spark, medium), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs_on_the_smallest_tables(spark, small, name):
    df = QUERIES[name](spark, small)
    operator = name.split("_")[0]
    source = {"op2": "pages", "op7": "embeddings"}.get(operator, "documents")
    rows = spark.read.parquet(f"{small}/{source}.parquet").count()
    found = df.count()
    if operator in ("op11", "op13"):
        assert found > 0
    else:
        assert found >= rows if operator == "op10" else found == rows
    assert len(df.columns) == len(set(df.columns))


def test_pipeline_stages_keep_the_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        docs = stage(spark, docs, small).cache()
        assert docs.columns == columns, name
        assert docs.count() == before if name == "private_data" else 0 < docs.count() <= before, name
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, small).collect()
    assert {r["doc_id"] for r in packed} == ids


def test_pipeline_stages_leave_clashing_columns(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").drop("n_chars")
    names = ["score", "predicted", "hits", "n_entities", "entity_types", "kept"]
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names}).cache()
    for name in ("quality", "decontaminate", "private_data"):
        kept = dict(corpus_pipeline.STAGES)[name](spark, docs, small)
        assert kept.columns == docs.columns
        rows = kept.select("doc_id", *names).collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in names), name
        assert dict(corpus_pipeline.STAGES)[name](spark, docs.limit(0), small).count() == 0
