"""Postings in blocks. A saved index has a row for each term and some two million tokens' worth of documents, with the places of the term in arrays:
it is shuffled and sorted in a fraction of the bytes that a row for each occurrence takes, and a document is counted once for each of its terms.

Blocks are cut into ranges of terms by weight, as a row may stand for one occurrence or for a hundred thousand; a frequent term has
several ranges. So what one task sorts is bounded by the number of ranges, whatever the terms."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of the documents that make a block; tokens that a range of terms holds at most, about.
TOKENS, RANGE_TOKENS = 2_000_000, 4_000_000
#: What a row weighs beside its occurrences, in occurrences; sampled rows for each range, about.
ROW, SAMPLED = 8, 30
BLOCK = "term string, space string, alive boolean, doc bigint, cnt bigint, ids array<bigint>, cols array<tinyint>, offs array<int>, sizes array<int>"
Finish = Callable[[list[str]], list[str]]


def rows_of(blocks: DataFrame) -> DataFrame:
    """A row for each occurrence: id, col, off, term, n_tokens, space, alive. A filter on terms goes to the scan of the blocks."""
    each = blocks.select("term", "space", "alive", F.explode(F.arrays_zip("ids", "cols", "offs", "sizes")).alias("p"))
    return each.select(F.col("p.ids").alias("id"), F.col("p.cols").cast("int").alias("col"), F.col("p.offs").alias("off"), "term", F.col("p.sizes").alias("n_tokens"), "space", "alive")


def of_rows(postings: DataFrame) -> DataFrame:
    """Blocks of single occurrences, one for each term of a document."""
    each = postings.groupBy("term", "id", "n_tokens", "space", "alive").agg(F.array_sort(F.collect_list(F.struct("col", "off"))).alias("p"))
    n = F.size("p")
    arrays = (F.array_repeat("id", n).alias("ids"), F.col("p.col").cast("array<tinyint>").alias("cols"), F.col("p.off").alias("offs"), F.array_repeat("n_tokens", n).alias("sizes"))
    return each.select("term", "space", "alive", F.lit(1).cast("long").alias("doc"), n.cast("long").alias("cnt"), *arrays)


def write(tokenised: DataFrame, finish: Finish | None, n_tokens: int, ranges: int, path: str) -> None:
    """Blocks of documents' tokens (id, space, alive, tt, tb), sorted by term within ranges of terms."""
    ranges = max(ranges, -(-n_tokens // RANGE_TOKENS))
    docs = tokenised.select("id", "space", "alive", "tt", "tb")
    rate = SAMPLED * ranges / max(n_tokens, 1)
    seen = docs.mapInArrow(lambda batches: _sample(batches, finish, rate), "term string, salt bigint").collect()
    keys = sorted((r["term"].encode(), r["salt"]) for r in seen)  # by bytes, as Spark sorts strings
    bounds = [keys[k * len(keys) // ranges] for k in range(1, ranges)] if keys else []
    made = docs.mapInArrow(lambda batches: _ranged(batches, finish, bounds), f"{BLOCK}, salt bigint, part int")
    made.repartitionById(ranges, "part").sortWithinPartitions("term", "salt").drop("salt", "part").write.mode("overwrite").parquet(path)


def _sample(batches: Iterator[pa.RecordBatch], finish: Finish | None, rate: float) -> Iterator[pa.RecordBatch]:
    for b, salt in _blocks(batches, finish):
        weight = b.column("cnt").to_numpy() + ROW
        some = np.flatnonzero(np.random.default_rng(salt).random(len(weight)) < weight * rate)
        yield pa.RecordBatch.from_arrays([b.column("term").take(pa.array(some)), pa.array(np.full(len(some), salt))], ["term", "salt"])


def _ranged(batches: Iterator[pa.RecordBatch], finish: Finish | None, bounds: list[tuple[bytes, int]]) -> Iterator[pa.RecordBatch]:
    for b, salt in _blocks(batches, finish):
        part = [bisect_right(bounds, (t, salt)) for t in b.column("term").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, salt)), pa.array(part, pa.int32())], [*b.schema.names, "salt", "part"])


def _blocks(batches: Iterator[pa.RecordBatch], finish: Finish | None) -> Iterator[tuple[pa.RecordBatch, int]]:
    """Blocks of documents, TOKENS or one document at a time, each with a number that spreads the blocks of a term."""
    held, n = [], 0
    for b in batches:
        sizes = sum(pc.fill_null(pc.list_value_length(b.column(c)), 0).to_numpy() for c in ("tt", "tb"))
        lo = 0
        for i, size in enumerate(sizes.tolist()):
            if n and n + size > TOKENS:
                held.append(b.slice(lo, i - lo))
                yield _block(held, finish)
                held, n, lo = [], 0, i
            n += size
        held.append(b.slice(lo))
    if n:
        yield _block(held, finish)


def _block(held: list[pa.RecordBatch], finish: Finish | None) -> tuple[pa.RecordBatch, int]:
    docs = pa.Table.from_batches(held).combine_chunks()
    ids = docs.column("id").to_numpy()
    sides = [docs.column(c).combine_chunks() for c in ("tt", "tb")]
    sides = [s.chunk(0) if isinstance(s, pa.ChunkedArray) else s for s in sides]
    lengths = [pc.fill_null(pc.list_value_length(s), 0).to_numpy().astype(np.int64) for s in sides]
    sizes = lengths[0] + lengths[1]
    begin = np.cumsum(sizes) - sizes
    encoded = pa.concat_arrays([s.flatten() for s in sides]).dictionary_encode()
    terms, code = encoded.dictionary.cast(pa.string()), encoded.indices.to_numpy()
    if finish:
        again = pa.array(finish(terms.to_pylist()), pa.string()).dictionary_encode()
        terms, code = again.dictionary, again.indices.to_numpy()[code]
    # every occurrence at its place in the order of documents, columns and offsets
    total = int(sizes.sum())
    row = np.repeat(np.arange(len(ids)), sizes)
    off = np.arange(total) - np.repeat(begin, sizes)
    body = off >= lengths[0][row]
    off = off - np.where(body, lengths[0][row], 0)
    placed = np.empty(total, np.int64)
    placed[~body], placed[body] = code[: lengths[0].sum()], code[lengths[0].sum() :]
    space = docs.column("space").combine_chunks()
    space = (space.chunk(0) if isinstance(space, pa.ChunkedArray) else space).dictionary_encode(null_encoding="encode")
    kind = space.indices.to_numpy().astype(np.int64) * 2 + docs.column("alive").to_numpy()
    kinds = 2 * len(space.dictionary)
    key = placed * kinds + kind[row]
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    first = np.flatnonzero(fresh)
    doc = np.add.reduceat((fresh | np.concatenate([[True], row[1:] != row[:-1]])).astype(np.int64), first)
    at = pa.array(np.append(first, total).astype(np.int32))
    own = key[first]
    columns = {
        "term": terms.take(pa.array(own // kinds)),
        "space": space.dictionary.take(pa.array(own % kinds // 2)).cast(pa.string()),
        "alive": pa.array(own % 2 == 1),
        "doc": pa.array(doc),
        "cnt": pa.array(np.diff(np.append(first, total)).astype(np.int64)),
        "ids": pa.ListArray.from_arrays(at, pa.array(ids[row])),
        "cols": pa.ListArray.from_arrays(at, pa.array(body[order].astype(np.int8))),
        "offs": pa.ListArray.from_arrays(at, pa.array(off[order].astype(np.int32))),
        "sizes": pa.ListArray.from_arrays(at, pa.array(sizes[row].astype(np.int32))),
    }
    return pa.RecordBatch.from_pydict(columns), int(ids[0]) * 0x9E3779B97F4A7C15 % 2**31
