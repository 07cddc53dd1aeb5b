"""Shards by the hash of the document id, and snapshots of a shard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import shard_of

IN_SYNC = 0.8


def parse_group(text: str) -> tuple[int, int]:
    """"2/5" -> (index 1, size 5)."""
    try:
        group, size = (int(x) for x in text.split("/"))
    except ValueError:
        raise ValueError("invalid shard group setting") from None
    if not 1 <= group <= size:
        raise ValueError("shard group out of range")
    return group - 1, size


def only(docs: DataFrame, index: int, size: int) -> DataFrame:
    return docs.where(shard_of(F.col("doc_id"), size) == index)


def spread(docs: DataFrame, size: int) -> DataFrame:
    return docs.groupBy(shard_of(F.col("doc_id"), size).alias("shard")).agg(F.count("*").alias("n_docs"))


def clone(docs: DataFrame, path: str, index: int, size: int) -> None:
    """Writes a shard's documents as a snapshot that a new worker, or a group of another size, starts from."""
    only(docs, index, size).write.mode("overwrite").parquet(path)


def needs_clone(own: int, source: int) -> bool:
    """Whether a worker with `own` documents should load a snapshot of `source` documents before it syncs."""
    return own <= IN_SYNC * source


def missing(workers: DataFrame, size: int) -> DataFrame:
    """Numbers (from 0) of shards without a worker."""
    every = workers.sparkSession.range(size).select(F.col("id").cast("int").alias("shard"))
    return every.join(workers.select(F.col("shard").cast("int").alias("shard")).distinct(), "shard", "left_anti")
