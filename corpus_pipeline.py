"""A training corpus from documents, in five stages, each an operator of quernstone.llm. A stage takes (spark, docs, sf_dir) and works on all that its
predecessor kept; run() writes each result as Parquet into the shared folder and reads it again as the next one's docs. A stage's files are deleted
as soon as the next one has been written; the last one's are the result.

All stages bear nulls in any column, empty and very long texts, repeated rows and ids, columns of any other name (these are kept up to the last
stage) and an empty table, each as its operator's docstring says: empty and null texts aren't toxic, form one group of equal texts, link with nothing, take no words
and have no ids; rows without doc_id are never learned from and are documents of their own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import op1_toxicity, op2_jaccard, op3_mix, op5_dedup, op8_bpe
from quernstone.session import delete, shared_dir, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled documents of the stage's input."""
    return op1_toxicity.clean(docs, op1_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays."""
    return op5_dedup.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity, directly or through others, the one with the smallest doc_id stays."""
    return op2_jaccard.thin(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: up to 3 times, or not at all."""
    return op3_mix.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each document of the mix."""
    return op8_bpe.encode(docs, *op8_bpe.public(), ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: SQL can express neither the trained classifier nor the rounding nor the tokenizer; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over documents, read from the shared folder."""
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
