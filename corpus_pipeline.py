"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import packing, quality, secrets, simhash, toxicity
from millrace.llm.queries import table, vocabulary
from millrace.llm.shared import Scratch


def clean_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under one half; the classifier learns from labelled documents of its input."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def clean_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the threshold table."""
    return quality.kept_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least id; documents without words form one group."""
    return simhash.without_near_copies(docs)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced."""
    return secrets.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs, *vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", clean_toxicity),
    ("quality", clean_quality),
    ("simhash", drop_near_copies),
    ("secrets", hide_secrets),
    ("packing", pack_sequences),
]

#: Classifiers and greedy packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes Parquet to the shared folder for the next one."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
