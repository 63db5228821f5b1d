"""Documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a
DataFrame that is written as Parquet and read again for the next; all but the last return the
columns of documents. Only the first reads another table, the labels.

Defined cases: a null or empty text is a document without words: the classifier scores it like any
other, no near duplicate is found for it, the mix counts it as 0 words and never takes it. Rows without a
doc_id, or with one that others have, are rows of their own; of rows alike in id and text one stays.
A null source or lang is a value like others. Very long texts are read whole. Other columns pass all
stages but the last, whatever their names. An empty table of documents gives an empty result; without
labels of both classes every document scores the share of label 1, so all stay or all go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagework.llm import jaccard, mixing, packing, pii, quality
from passagework.llm.common import table, written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle similarity."""
    return jaccard.distinct_documents(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    return pii.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.selected(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.digest(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", private_data),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", packed),
]

#: No SQL: the classifier, the seeded mix and the packing can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
