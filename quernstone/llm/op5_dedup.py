"""Exact dedup (operator 5): a Misra-Gries sketch finds the digests that may be frequent; exact counts verify them; the
winners' groups are settled at the map side from a broadcast table of at most COUNTERS rows, all other digests by an ordinary shuffle.

Texts are equal when identical after lower-casing A-Z only. Null text counts as empty, and empty texts form a group like any
other. The row with the largest doc_id stays; a null doc_id counts as smaller than any other; of rows that repeat a doc_id
within a group one (any) stays. Texts of any length are compared whole. Other columns are ignored by `classify`, and kept by `deduplicate`, whatever their names.
An empty table gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import as_bytes, by_bytes, may_broadcast, text_of, tidily
from quernstone.session import cut, table

#: Counters of a sketch. A digest that more than 2 / COUNTERS of all rows have is always among the candidates.
COUNTERS = 4096


@tidily
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        # bytes.lower() changes A-Z alone
        found = [hashlib.sha256(t.lower()).digest() for t in as_bytes(b.column(1))]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["doc_id", "digest"])


def _prune(counters: dict[int, int], k: int) -> dict[int, int]:
    if len(counters) <= k:
        return counters
    off = sorted(counters.values(), reverse=True)[k]
    return {x: n - off for x, n in counters.items() if n > off}


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Misra-Gries over the first 8 bytes of each digest, a batch at a time: add the batch's counts, then take the
    (k+1)-th largest from all and drop what falls to 0."""
    counters: dict[int, int] = {}
    for b in batches:
        keys, counts = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_counts=True)
        for x, n in zip(keys.tolist(), counts.tolist()):
            counters[x] = counters.get(x, 0) + n
        counters = _prune(counters, COUNTERS)
    yield pa.RecordBatch.from_arrays([pa.array(list(counters), pa.int64()), pa.array(list(counters.values()), pa.int64())], ["head", "n"])


def digests(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, digest, head) of each row, in the shared folder."""
    by_bytes(docs.sparkSession)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_digest, "doc_id long, digest binary")
    head = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")
    return cut(found.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "digest", head.alias("head")))


def winners(rows: DataFrame) -> DataFrame:
    """(digest, group_size, keep) of the verified heavy hitters; at most COUNTERS rows."""
    sums = rows.select("head").mapInArrow(_sketch, "head long, n long").groupBy("head").agg(F.sum("n").alias("n"))
    candidates = sums.orderBy(F.desc("n"), "head").limit(COUNTERS).select("head")
    exact = (
        rows.join(F.broadcast(candidates), "head", "left_semi")
        .groupBy("digest")
        .agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "uid")).alias("keep"))
    )
    return cut(exact.where("group_size > 1").orderBy(F.desc("group_size"), "digest").limit(COUNTERS))


def settle(rows: DataFrame) -> DataFrame:
    """(uid, doc_id, digest, keep_id, group_size, kept) for each row of digests()."""
    hot = winners(rows)
    marked = rows.join(F.broadcast(hot), "digest", "left")
    # as a column, not a filter on either branch alone: the marked side is read once by each branch and nothing but ids moves
    a = marked.where("keep is not null")
    group = Window.partitionBy("digest")
    b = (
        marked.where("keep is null")
        .select("uid", "doc_id", "digest")
        .withColumn("group_size", F.count("*").over(group))
        .withColumn("keep", F.max(F.struct("doc_id", "uid")).over(group))
    )
    out = ["uid", "doc_id", "digest", "group_size", "keep"]
    return a.select(*out).unionByName(b.select(*out)).select(
        "uid", "doc_id", "digest", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("keep.uid")).alias("kept")
    )


def classify(docs: DataFrame) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    return settle(digests(docs)).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns. Only ids move: the rows to drop (or their ids, if small, broadcast)
    are anti-joined; rows whose doc_id repeats are told apart by their text's digest."""
    settled = cut(settle(digests(docs)).select("doc_id", "digest", "kept"))
    ids = settled.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("stays"))
    gone, repeated = F.expr("not stays and doc_id is not null"), F.expr("n > 1 or doc_id is null")
    drop, again = ids.where(gone).select("doc_id"), ids.where(repeated).select("doc_id")
    sizes = ids.agg(F.count_if(gone), F.count_if(repeated)).first()
    single = docs.join(may_broadcast(drop, sizes[0], 16), "doc_id", "left_anti") if sizes[0] else docs
    if not sizes[1]:
        return single
    # rows that repeat a doc_id (or have none): one row for each kept digest
    once = _split(single, again, sizes[1], "left_anti")
    twice = _split(single, again, sizes[1], "left_semi").withColumn("__digest", F.unhex(F.sha2(_lower(text_of()), 256)))
    keep = settled.where("kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest")).distinct()
    twice = twice.join(keep, (twice["doc_id"].eqNullSafe(keep["__id"])) & (twice["__digest"] == keep["__digest"]), "left_semi")
    twice = twice.dropDuplicates(["doc_id", "__digest"]).drop("__digest")
    return once.unionByName(twice)


def _split(df: DataFrame, ids: DataFrame, n: int, how: str) -> DataFrame:
    ids = ids.select(F.col("doc_id").alias("__again"))
    return df.join(may_broadcast(ids, n, 16), df["doc_id"].eqNullSafe(ids["__again"]), how)


def _lower(c):
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))


SQL = """
with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) h from documents)
select doc_id, max(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
       doc_id = max(doc_id) over (partition by h) as kept, h as text_sha256 from d
"""
