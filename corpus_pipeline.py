"""A training corpus from raw documents: quality, near copies, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, folder of the tables) and returns what the next one reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.llm.decontaminate import drop_contaminated
from panelcast.llm.minhash import keep_one
from panelcast.llm.packing import pack
from panelcast.llm.pii import replace_personal_data
from panelcast.llm.quality import score_quality, train
from panelcast.llm.shared import table, written


def _held(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, all other columns in one that no operator names: they cannot clash."""
    others = [docs[f"`{c}`"].alias(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others, F.lit(True).alias("__")).alias("__others"))


def _as_before(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns that ``_held`` took away, in their order, some of them with new values."""
    own = {c: F.col(c) if c in ("doc_id", "text") else F.col("__others")[c] for c in columns}
    return rows.select(*[changed.get(c, own[c]).alias(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Null and empty texts are scored as such, repeated rows each; an empty table stays empty. Columns of
    any name stay as they are.
    """
    model = train(docs, table(spark, folder, "labels"))
    return _as_before(score_quality(_held(docs), model).where("predicted = 1"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8.

    Documents without words are in no group; of rows that repeat an id one stays.
    """
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without any passage of the benchmark; null and empty texts have none, columns stay."""
    return _as_before(drop_contaminated(_held(docs), table(spark, folder, "benchmark")), docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, personal data replaced; ``n_chars``, where there is one, is that of the new text.

    Equal values get equal surrogates in all rows; null and empty texts stay, and so do other columns.
    """
    rows = replace_personal_data(_held(docs))
    if "n_chars" not in docs.columns:
        return _as_before(rows, docs.columns)
    length = F.when(F.col("n_entities") > 0, F.length("text").cast("long")).otherwise(F.col("__others")["n_chars"])
    return _as_before(rows, docs.columns, n_chars=length)


def packing(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of every document and their places in sequences of 1024 tokens."""
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("private_data", private_data),
    ("packing", packing),
]

#: The discriminant, minwise trees and tokenizer of the stages are not SQL; tests hold the
#: result against the stages one by one and against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, folder), f"stage-{name}")
    return STAGES[-1][1](spark, docs, folder)
