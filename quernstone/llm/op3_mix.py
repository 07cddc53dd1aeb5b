"""Mixing sources to target weights (operator 3) by pivotal dependent rounding. A source's documents all get the same fractional
number of copies, target / size of the source. Its whole part is given outright; the fractions are paired, and words are moved
at random from one document of a pair to the other (with the odds that keep each one's expectation) until one of them is
integral, so a source's taken words never leave its target until its last fraction is rounded: they end within one
document's size of it. Every bucket of ids leaves at most one fraction of each source; these are combined in a tree of FAN
buckets at a time.

Nothing depends on the cluster: buckets come from hashes of doc_id and their number from the number of rows, so reruns agree.
Null text has size 0; a null source is a source, the last. Rows that share doc_id and source count as one document of their
joint size and get the same number of copies; rows without doc_id are documents of their own, numbered by their place in the input. Texts of any
length count whole; columns with other names, whatever they are, play no part. Documents of size 0 take no words; each is rounded by itself. A source without
any words has target 0 and keeps its documents once. An empty table gives an empty result."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import attach, as_bytes, by_bytes, may_broadcast, pieces, text_of, tidily, word_bounds
from quernstone.session import cut, table

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
BUCKET_ROWS, FAN = 100_000, 64
MASK = 2**64 - 1


@tidily
def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column of each batch becomes its number of words."""
    for b in batches:
        texts = as_bytes(b.column(b.num_columns - 1))
        counts = np.empty(len(texts), np.int64)
        for lo, hi in pieces(texts, 1 << 20):
            ends = np.cumsum([len(t) for t in texts[lo:hi]], dtype=np.int64)
            starts, _ = word_bounds(np.frombuffer(b"".join(texts[lo:hi]), np.uint8), ends)
            counts[lo:hi] = np.diff(np.searchsorted(starts, ends), prepend=0)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(counts)], [*b.schema.names[:-1], "size"])


def marked(docs: DataFrame) -> DataFrame:
    """docs with __unit: a number for each row without doc_id, which then stands in the shared folder so that it keeps its number; null for the others."""
    by_bytes(docs.sparkSession)
    lost = docs.where("doc_id is null")
    if lost.isEmpty():
        return docs.withColumn("__unit", F.lit(None).cast("long"))
    return docs.where("doc_id is not null").withColumn("__unit", F.lit(None).cast("long")).unionByName(cut(lost.withColumn("__unit", F.monotonically_increasing_id())))


def _skey() -> Column:
    """Sorts as the source does, null last."""
    return F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, unit, skey, size) of each row of marked(), in the shared folder."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__unit").alias("unit"), _skey().alias("skey"), text_of().alias("text"))
    return cut(plain.mapInArrow(word_counts, "doc_id long, unit long, skey string, size long"))


def targets(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(skey, n_rows, source_size, target). The table of sources is sorted and numbered across partitions; each round of
    sharing is one aggregation of it."""
    spark = rows.sparkSession
    sources = cut(rows.groupBy("skey").agg(F.count("*").alias("n_rows"), F.sum("size").alias("source_size")))
    numbered = sources.orderBy("skey").rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[0][2], float(weights[x[1] % len(weights)])))
    s = cut(spark.createDataFrame(numbered, "skey string, n_rows long, source_size long, w double"))
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0

    while total:
        over = F.col("w") * F.lit(level) > F.lit(most) * F.col("source_size")
        fixed, free = s.agg(F.sum(F.when(over, F.lit(most) * F.col("source_size"))), F.sum(F.when(~over, F.col("w")))).first()
        following = (total - (fixed or 0.0)) / free if free else level
        if following <= level:
            break
        level = following
    return s.select("skey", "n_rows", "source_size", F.least(F.lit(most) * F.col("source_size"), F.lit(level) * F.col("w")).alias("target"))


_OUT = "bucket long, skey string, doc_id long, unit long, size long, h long, whole long, p double, copies long"


def _draw(a: int, b: int) -> float:
    """A number in [0, 1) from two hashes."""
    x = (a * 0x9E3779B97F4A7C15 + b * 0xD1342543DE82EF95 + 0x2545F4914F6CDD1D) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return ((x ^ (x >> 31)) >> 11) / 2**53


@tidily
def _pivot(last: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by bucket, source and falling size (so that large documents are settled against many small ones, and what
    is left over is small): settles all of a bucket's documents of a source but at most one, whose copies stay
    null unless it is the last level."""
    held = None  # the fraction carried: [bucket, skey, doc_id, unit, size, h, whole, p]

    def settled(row: list, one: bool) -> tuple:
        return (*row[:7], 0.0, row[6] + one)

    def left(row: list) -> tuple:
        return settled(row, _draw(row[5], 7) < row[7]) if last else (*row, None)

    for b in batches:
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in b.columns)):
            row = list(row)
            p, size = row[7], row[4]
            if p < 1e-9 or p > 1 - 1e-9 or not size:
                out.append(settled(row, _draw(row[5], 3) < p if 1e-9 <= p <= 1 - 1e-9 else p > 0.5))
                continue
            if held is None or held[:2] != row[:2]:
                if held is not None:
                    out.append(left(held))
                held = row
                continue
            a, q = held[4], held[7]  # words are moved between held and row
            up, down = min((1 - q) * a, p * size), min(q * a, (1 - p) * size)
            if _draw(held[5], row[5]) < down / (up + down):
                held[7], row[7] = q + up / a, p - up / size
            else:
                held[7], row[7] = q - down / a, p + down / size
            rest = None
            for x in (held, row):
                if 1e-9 < x[7] < 1 - 1e-9:
                    rest = x
                else:
                    out.append(settled(x, x[7] > 0.5))
            held = rest
        yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in out], schema=_SCHEMA)
    if held is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, left(held)))], schema=_SCHEMA)


_NAMES = [x.split()[0] for x in _OUT.split(", ")]
_SCHEMA = pa.schema([(n, pa.string() if n == "skey" else pa.float64() if n == "p" else pa.int64()) for n in _NAMES])


def copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the rows of marked(): those of sized(); for each doc_id, unit and skey its unit_copies; the table of targets()."""
    rows = sized(docs)
    per_source = cut(targets(rows, weights, most))
    units = rows.groupBy("doc_id", "unit", "skey").agg(F.sum("size").alias("size"))
    n = per_source.agg(F.sum("n_rows")).first()[0] or 0
    buckets = max(1, math.ceil(n / BUCKET_ROWS))
    f = F.when(F.col("source_size") == 0, F.lit(1.0)).otherwise(F.col("target") / F.col("source_size"))
    rated = attach(units, per_source, "skey", n, count="n_rows").withColumns({"h": F.xxhash64("doc_id", "unit", "skey", F.lit(seed)), "f": f})
    start = rated.select(
        F.pmod(F.xxhash64("doc_id", "unit", F.lit(0)), F.lit(buckets)).alias("bucket"), "skey", "doc_id", "unit", "size", "h", F.floor("f").alias("whole"), (F.col("f") - F.floor("f")).alias("p")
    )
    done, level = None, start
    while True:
        last = buckets == 1
        ordered = level.repartition("bucket").sortWithinPartitions("bucket", "skey", F.desc("size"), "doc_id", "unit")
        out = cut(ordered.mapInArrow(functools.partial(_pivot, last), _OUT))
        some = out.where("copies is not null").select("doc_id", "unit", "skey", F.col("copies").alias("unit_copies"))
        done = some if done is None else done.unionByName(some)
        if last:
            break
        buckets = math.ceil(buckets / FAN)
        level = out.where("copies is null").withColumn("bucket", F.floor(F.col("bucket") / FAN)).drop("copies")
    return rows, done, per_source


def _with_copies(rows: DataFrame, units: DataFrame, doc_id: Column, unit: Column, skey: Column, n: int) -> DataFrame:
    """rows joined with the copies of their units, of which there are n at most; the units' columns begin with __."""
    units = units.select(*(F.col(c).alias(f"__{c}") for c in ("doc_id", "skey", "unit_copies")), F.col("unit").alias("__of"))
    return rows.join(may_broadcast(units, n, 72), doc_id.eqNullSafe(F.col("__doc_id")) & unit.eqNullSafe(F.col("__of")) & (skey == F.col("__skey")))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row."""
    rows, units, per_source = copies(marked(docs))
    n = per_source.agg(F.sum("n_rows")).first()[0] or 0
    joined = _with_copies(rows, units, F.col("doc_id"), F.col("unit"), F.col("skey"), n).select("doc_id", "skey", "size", "__unit_copies")
    full = attach(joined, per_source, "skey", n, count="n_rows")
    return full.select("doc_id", "size", "source_size", "target", (F.col("__unit_copies") * F.col("size")).cast("long").alias("taken"), F.col("__unit_copies").alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as many times as the mix takes it."""
    all_rows = marked(docs)
    _, units, per_source = copies(all_rows)
    n = per_source.agg(F.sum("n_rows")).first()[0] or 0
    taken = _with_copies(all_rows, units.where("unit_copies > 0"), F.col("doc_id").cast("long"), F.col("__unit"), _skey(), n)
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__unit_copies").cast("int")))).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
