"""What the operators of this subpackage share: Arrow text batches, hashing of words in numpy, size-checked joins, heavy keys."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its measured rows times its row width stay within this.
BROADCAST_BYTES = 16 << 20

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
U64 = np.uint64


#: Bytes of an Arrow batch of texts, unless the session names its own number.
BATCH_BYTES, _BATCH = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def by_bytes(spark: SparkSession) -> None:
    """Lets Arrow batches end by bytes as well as by rows: ten thousand long texts at once would need any amount of memory, in the JVM and in the
    worker. A number of bytes that the session has set itself stays."""
    if _BATCH not in {k for k, _ in spark.sparkContext.getConf().getAll()} and spark.conf.get("quernstone.batches", "") != "by bytes":
        spark.conf.set(_BATCH, str(BATCH_BYTES))
        spark.conf.set("quernstone.batches", "by bytes")


def tidy() -> None:
    """Gives free memory back: workers live on, and without this each keeps the most that any of its tasks has taken."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library than glibc
        pass


def tidily(f: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """A map over batches that tidies up at its end."""

    @functools.wraps(f)
    def run(*args):
        try:
            yield from f(*args)
        finally:
            tidy()

    return run


def text_pieces(column: pa.Array, limit: int) -> Iterator[tuple[int, int, list[str]]]:
    """lo, hi and the texts [lo, hi) of a column, about limit bytes at a time; null counts as empty."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    for lo, hi in pieces(sizes, limit):
        yield lo, hi, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def may_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if rows * row_bytes, measured by the caller, is within BROADCAST_BYTES; else df as it is, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def partitions_for(df: DataFrame, bytes_each: int = 256 << 20, most: int = 21_845) -> int:
    """spark.sql.shuffle.partitions, or more if the plan's size, as the optimizer estimates it, asks for it."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    known = size if size < 1 << 58 else 0  # the estimate of a plan of unknown size is boundless
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(most, -(-known // bytes_each)))


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type):
        column = column.cast(kind)
    return [b or b"" for b in column.to_pylist()]


def pieces(texts: list[bytes] | list[str] | np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges [lo, hi) of texts (or of their sizes) of about limit bytes, at least one text each."""
    lo, held = 0, 0
    for i, n in enumerate(texts.tolist() if isinstance(texts, np.ndarray) else map(len, texts)):
        if held and held + n > limit:
            yield lo, i
            lo, held = i, 0
        held += n + 64
    if lo < len(texts):
        yield lo, len(texts)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer: a bijection, so that it adds no collisions."""
    h = h ^ (h >> U64(30))
    h *= M1
    h ^= h >> U64(27)
    h *= M2
    h ^= h >> U64(31)
    return h


SEGMENT = 1 << 19
_made: dict[str, np.ndarray] = {}


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not _made:
        rng = np.random.Generator(np.random.PCG64(0x5EED))
        byte = rng.integers(0, 2**64, 256, dtype=U64)
        byte[65:91] = byte[97:123]  # A-Z as a-z
        p = 0x9E3779B97F4A7C15
        up, down = (np.full(SEGMENT + 1, U64(x)) for x in (p, pow(p, -1, 2**64)))
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            _made["byte"], _made["up"], _made["down"] = byte, np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        space = np.zeros(256, bool)
        space[[0x20, *range(0x09, 0x0E)]] = True
        _made["space"] = space
    return _made["byte"], _made["up"], _made["down"]


def word_bounds(buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ in buf; a word also ends at each position of cuts (ascending)."""
    _tables()
    inside = ~_made["space"][buf]
    edge = np.empty(len(buf) + 1, bool)
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge[0], edge[-1] = inside[0], inside[-1]
    edge[1:-1] = inside[1:] != inside[:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(buf))]
    both = np.unique(cuts[inside[cuts] & inside[cuts - 1]])
    at = np.flatnonzero(edge)
    if len(both):  # at such a cut one word ends and the next begins
        at = np.sort(np.concatenate([at, both, both]))
    return at[0::2], at[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, letters A-Z taken as a-z: sums over byte values times powers of an odd number, mixed. A word's hash doesn't depend on its place."""
    byte, up, down = _tables()
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = int(np.searchsorted(ends, base + SEGMENT, side="right"))
        if j <= i:  # a word longer than a segment
            h, w = 0, buf[base : int(ends[i])]
            for k in range(0, len(w), SEGMENT):
                part = w[k : k + SEGMENT]
                h = (h * 0xD1342543DE82EF95 + int(np.sum(byte[part] * up[: len(part)], dtype=U64))) % 2**64
            out[i] = h
            i += 1
            continue
        sums = np.empty(int(ends[j - 1]) - base + 1, U64)
        sums[0] = 0
        np.cumsum(byte[buf[base : int(ends[j - 1])]] * up[: len(sums) - 1], dtype=U64, out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return mix(out)


def heavy_split(counts: DataFrame, key: str, rows: int, most: int = 1000, count: str = "group_size") -> tuple[DataFrame, DataFrame]:
    """counts split into the groups that hold more than a most-th of all rows (fewer than most of them, whatever the data, so they may be broadcast) and the rest."""
    bound = F.lit(max(1, rows // most))
    return counts.where(F.col(count) > bound), counts.where(F.col(count) <= bound)


def attach(rows: DataFrame, groups: DataFrame, key: str, total: int, most: int = 1000, count: str = "group_size") -> DataFrame:
    """rows joined to the group table of their key. Hot groups (see heavy_split) are joined at the map side, so no task gets one whole."""
    hot, cold = heavy_split(groups, key, total, most, count)
    tagged = rows.join(F.broadcast(hot.select(key, F.lit(True).alias("__hot"))), key, "left")
    a = tagged.where("__hot").drop("__hot").join(F.broadcast(hot), key)
    b = tagged.where("__hot is null").drop("__hot").join(cold, key)
    return a.unionByName(b)
