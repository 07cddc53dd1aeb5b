"""Sharding (operator 6) by Karmarkar-Karp differencing, law `bytes`: groups of equal texts stay whole, and the shards' bytes are
as near equal as such groups allow. In each chunk of groups the two partial partitions with the largest spread are combined,
oppositely ordered, until one is left; the chunks' partial partitions are combined the same way, up to FAN at a time, until
one partition of everything is left. Only group sums move; rows get their shard by a join in which hot groups are broadcast.

Size is the UTF-8 bytes of the text (null: none) plus 1; null and empty texts form one group, crc32 0. Repeated rows are rows of
their own. Slots are gapless from 0 in each shard: rows are numbered within (shard, bucket) and start where the counts
of the buckets before end; ties of doc_id are numbered in any order. Texts of any length count whole; columns of other names play no part. An empty
table gives an empty result."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import attach, may_broadcast, text_of
from quernstone.session import cut, table

CHUNK, FAN = 50_000, 4096


def differencing(parts: list[list[int]], k: int) -> tuple[list[list[int]], list[int]]:
    """parts: partial partitions, each a list of at most k sums. Returns, for each part, the bin that each of its sums goes to, and
    the sums of the k bins."""
    label: list[int] = []  # leaves: (part, place) in order; then merged sets
    left: list[int] = []
    right: list[int] = []
    heap, owner = [], []
    for i, sums in enumerate(parts):
        bins = []
        for s in sums:
            bins.append((s, len(label)))
            label.append(0)
        owner.append([x[1] for x in bins])
        bins = sorted(bins, reverse=True)[:k] + [(0, -1)] * (k - len(bins))
        heap.append((bins[-1][0] - bins[0][0], i, bins))
    leaves, count = len(label), len(heap)
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        b = heap[0][2]
        new = []
        for (s, x), (t, y) in zip(a, reversed(b)):
            if x < 0 or y < 0:
                new.append((s + t, max(x, y)))
            else:
                new.append((s + t, leaves + len(left)))
                left.append(x)
                right.append(y)
        new.sort(reverse=True)
        heapq.heapreplace(heap, (new[-1][0] - new[0][0], count, new))
        count += 1
    label += [0] * len(left)
    bins = heap[0][2] if heap else []
    for i, (_, x) in enumerate(bins):
        if x >= 0:
            label[x] = i
    for m in range(len(left) - 1, -1, -1):
        label[left[m]] = label[right[m]] = label[leaves + m]
    return [[label[x] for x in own] for own in owner], [s for s, _ in bins]


def _groups(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, item, bin, bytes) sorted by chunk, item -> (chunk, item, bin, to), the bin that each goes to. A chunk holds about CHUNK groups (or FAN partial partitions), so it is bounded."""
    held: list[pa.RecordBatch] = []

    def flush(rows: pa.Table) -> pa.RecordBatch:
        items = rows["item"].to_pylist()
        cuts = [0, *(i for i in range(1, len(items)) if items[i] != items[i - 1]), len(items)]
        sums = rows["bytes"].to_pylist()
        to, _ = differencing([sums[a:b] for a, b in zip(cuts, cuts[1:])], k)
        arrays = [rows[c].combine_chunks() for c in ("chunk", "item", "bin")] + [pa.array([x for t in to for x in t], pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, ["chunk", "item", "bin", "to"])

    for b in batches:
        chunks = b.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
        for lo, hi in zip(edges, edges[1:]):
            if hi > lo:
                if held and held[-1].column(0)[0].as_py() != chunks[lo]:
                    yield flush(pa.Table.from_batches(held))
                    held = []
                held.append(b.slice(lo, hi - lo))
    if held:
        yield flush(pa.Table.from_batches(held))


def assign(groups: DataFrame, n_groups: int, k: int = 16) -> DataFrame:
    """groups (digest, bytes, ...) -> digest, shard."""
    chunks = max(1, math.ceil(n_groups / CHUNK))
    chunk = F.pmod(F.xxhash64("digest"), F.lit(chunks))
    level = groups.select(chunk.alias("chunk"), F.col("digest").alias("item"), F.lit(0).alias("bin"), "bytes")
    result = None
    while True:
        item = "binary" if result is None else "long"
        solved = level.repartition("chunk").sortWithinPartitions("chunk", F.desc("bytes") if result is None else "item", "item", "bin")
        out = cut(solved.mapInArrow(lambda x: _groups(k, x), f"chunk long, item {item}, bin int, to int"))
        if result is None:
            result = out.select(F.col("item").alias("digest"), F.col("chunk").alias("part"), F.col("to").alias("shard"))
        else:
            up = out.select(F.col("item").alias("part"), F.col("bin").alias("shard"), F.col("chunk").alias("__part"), F.col("to").alias("__shard"))
            result = result.join(may_broadcast(up, chunks * k, 32), ["part", "shard"]).select("digest", F.col("__part").alias("part"), F.col("__shard").alias("shard"))
        if chunks == 1:
            return result.select("digest", "shard")
        sums = level.join(out, ["chunk", "item", "bin"])
        level = sums.groupBy("chunk", "to").agg(F.sum("bytes").alias("bytes"))
        chunks = math.ceil(chunks / FAN)
        level = cut(level.select(F.pmod(F.col("chunk"), F.lit(chunks)).alias("chunk"), F.col("chunk").alias("item"), F.col("to").alias("bin"), "bytes"))


def shard(docs: DataFrame, k: int = 16, bucket_rows: int = 100_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each row."""
    text = text_of()
    rows = cut(
        docs.select(
            F.monotonically_increasing_id().alias("uid"),
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        )
    )
    groups = cut(rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("group_size")))
    n_groups, n = groups.agg(F.count("*"), F.sum("group_size")).first()
    n = n or 0
    placed = groups.join(assign(groups, n_groups, k), "digest").select("digest", "group_size", "shard")
    buckets = max(1, math.ceil(n / bucket_rows))
    bucket = F.pmod(F.xxhash64("uid"), F.lit(buckets))
    whole = cut(attach(rows, cut(placed), "digest", n).select("uid", "doc_id", "size", "text_crc32", "shard", bucket.alias("bucket")))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = whole.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    first = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "uid")) - 1
    slotted = whole.withColumn("own", own).join(may_broadcast(first, k * buckets, 24), ["shard", "bucket"])
    return slotted.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("first") + F.col("own")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
