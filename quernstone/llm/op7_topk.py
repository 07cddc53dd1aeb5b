"""Exact top-k search by inner product (operator 7) with multi-resolution segment statistics. Vectors are grouped about centroids; what a vector has
besides its centroid is cut into segments, whose means and deviations bound the inner product from above (equally: the distance from below), by
Cauchy-Schwarz: q.x <= q.c + sum over segments of n * mean(q) * mean(x - c) + dev(q) * dev(x - c). Candidates that the coarse bound leaves are bounded
again by finer segments; the pairs that are left are computed exactly.

Centroids are the CENTROIDS rows of least hash (of few rows one in ROWS_EACH), a bounded sample that decides on nothing but the grouping: every row is assigned to
the nearest, and a group of more than BLOCK rows is split by hash into blocks. Each query searches its own block first, which gives a mark: its k-th
best score so far. It is then sent to those other blocks only whose envelope (the extremes of the segments' statistics) admits a score that
reaches the mark; a block's best k of each query are merged at the end. The envelopes, at most ENVELOPES and a few of each group, go with the tasks.

Components become floor(256 * x). Vectors that are null or hold null or non-finite components, and rows without vec_id, take no
part. A shorter vector counts as filled up with zeros. The query's own row (not its vec_id) is no candidate; repeated rows are candidates and
queries of their own; ties go to the smaller vec_id. Fewer candidates than k: all of them. An empty table gives an empty result; columns of
other names, whatever they are, play no part. A score that a long can't hold is an error, never a wrong number."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import by_bytes, tidily
from quernstone.session import cut, table

BLOCK, TILE, AT_ONCE, LEVELS = 262_144, 8192, 256, (4, 16, 32)
CENTROIDS, ROWS_EACH, ENVELOPES = 256, 4000, 16_384


def quantised(vectors: DataFrame) -> DataFrame:
    """(uid, vec_id, q) of the vectors that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    q = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    good = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(~bad)
    return cut(good.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), q.alias("q")))


def _matrix(column: pa.Array) -> np.ndarray:
    lens = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    d = int(lens.max(initial=0))
    if (lens == d).all():
        return flat.reshape(len(lens), d)
    out = np.zeros((len(lens), d), np.int64)
    out[np.arange(d)[None] < lens[:, None]] = flat
    return out


def _wide(m: np.ndarray, d: int) -> np.ndarray:
    return m if m.shape[1] == d else np.pad(m, ((0, 0), (0, d - m.shape[1])))


def features(f: np.ndarray, segments: int) -> np.ndarray:
    """For each segment sqrt(n) * mean and sqrt(sum of squared deviations): the dot product of two rows bounds the inner product."""
    cuts = np.unique(np.linspace(0, f.shape[1], segments + 1).astype(int))
    if len(cuts) < 2:
        return np.zeros((len(f), 2))
    n = np.diff(cuts).astype(float)
    total = np.add.reduceat(f, cuts[:-1], axis=1)
    square = np.add.reduceat(f * f, cuts[:-1], axis=1)
    dev = np.sqrt(np.maximum(square - total**2 / n, 0) + 1e-9 * square)
    return np.hstack([total / np.sqrt(n), dev])


def nearest(centroids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The number of the nearest centroid to each row; which of two is taken changes no result."""
    d = max(x.shape[1], centroids.shape[1])
    c, f = _wide(centroids, d).astype(float), _wide(x, d).astype(float)
    return (f @ c.T - (c * c).sum(1) / 2).argmax(1)


def envelope(f: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Least and greatest mean and greatest deviation of each segment of f - c, at the middle level; then the greatest norm of f - c, for rounding."""
    rest = features(f - c, LEVELS[1])
    half = rest.shape[1] // 2
    return np.concatenate([rest[:, :half].min(0), rest[:, :half].max(0), rest[:, half:].max(0), [np.sqrt(((f - c) ** 2).sum(1)).max()]])


def admits(q: np.ndarray, c: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Upper bounds of the queries' (rows) inner products with any vector of the blocks (rows of c, their centroids, and e, their envelopes)."""
    own = features(q, LEVELS[1])
    half = own.shape[1] // 2
    mean, dev = own[:, :half], own[:, half:]
    low, high, most = e[:, :half], e[:, half : 2 * half], e[:, 2 * half : 3 * half]
    bound = q @ c.T + np.maximum(mean, 0) @ high.T + np.minimum(mean, 0) @ low.T + dev @ most.T
    norm = np.sqrt((q * q).sum(1))[:, None]
    return bound + 1e-9 * norm * (e[:, -1] + np.sqrt((c * c).sum(1)))[None] + 0.25


class Block:
    """Vectors in the order of vec_id with the statistics of what they have besides the centroid, and the search in them by tiles."""

    def __init__(self, uids: np.ndarray, ids: np.ndarray, x: np.ndarray, centroid: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.uids, self.ids, self.centroid = uids[order], ids[order], centroid
        self.exact = 0  # pairs whose score was computed
        self.widen(x[order])

    def widen(self, x: np.ndarray) -> None:
        self.x, self.f = x, x.astype(np.float64)
        self.c = _wide(self.centroid[None], x.shape[1])[0].astype(np.float64)
        rest = self.f - self.c
        self.most = float(np.abs(self.f).max(initial=0))
        self.levels = [features(rest, s) for s in LEVELS]
        self.norm = float(np.sqrt((rest**2).sum(1)).max(initial=0)) + float(np.sqrt(self.c @ self.c))

    def tiles(self) -> Iterator[tuple[int, int]]:
        """Small ones first: they set the marks that later ones are held against."""
        lo, size = 0, min(TILE, 256)
        while lo < len(self.ids):
            yield lo, min(len(self.ids), lo + size)
            lo, size = lo + size, min(TILE, 4 * size)

    def search(self, quids: np.ndarray, q: np.ndarray, k: int, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places of each query's k best that reach its mark, falling; a place of -1 is none. A tile's vectors have larger ids than those before it,
        so a vector must exceed the k-th best so far to count."""
        d = max(q.shape[1], self.x.shape[1], len(self.centroid))
        if d > self.x.shape[1]:
            self.widen(_wide(self.x, d))
        q = _wide(q, d)
        f = q.astype(np.float64)
        exactly = self.most * float(np.abs(f).max(initial=0)) * max(1, d) < 2**53  # sums of products are whole numbers that float64 holds
        own, base = [features(f, s) for s in LEVELS], f @ self.c
        slack = 1e-9 * np.sqrt((f**2).sum(1)) * self.norm + 0.25
        best = np.full((len(q), k), -np.inf) if exactly else np.full((len(q), k), None, object)
        at = np.full((len(q), k), -1, np.int64)
        least = marks - np.maximum(1, 1e-9 * np.abs(marks))  # scores are whole: to exceed this is to reach the mark
        for lo, hi in self.tiles():
            part = slice(lo, hi)
            open_ = self.uids[part][None] != quids[:, None]
            for mine, level in zip(own, self.levels):
                columns = np.flatnonzero(open_.any(0))
                if not len(columns) or np.isneginf(least).all():
                    break
                bound = mine @ level[part][columns].T
                open_[:, columns] &= bound > (least - slack - base)[:, None]
            rows, cells = np.nonzero(open_)
            if not len(rows):
                continue
            if not exactly:
                self.exact += len(rows)
                values = np.array([sum(map(int.__mul__, x, y)) for x, y in zip(q[rows].tolist(), self.x[part][cells].tolist())], object)
            elif 2 * len(rows) < open_.size:
                self.exact += len(rows)
                values = np.empty(len(rows))
                for o in range(0, len(rows), 100_000):
                    values[o : o + 100_000] = np.einsum("ij,ij->i", f[rows[o : o + 100_000]], self.f[part][cells[o : o + 100_000]])
                keep = values > least[rows]
                rows, cells, values = rows[keep], cells[keep], values[keep]
            else:  # too many to fetch one by one: whole columns
                columns = np.flatnonzero(open_.any(0))
                self.exact += len(columns) * len(q)
                scores = np.where(open_[:, columns], f @ self.f[part][columns].T, -np.inf)
                reach = np.partition(scores, max(0, scores.shape[1] - k), axis=1)[:, max(0, scores.shape[1] - k)]
                rows, cells = np.nonzero((scores >= reach[:, None]) & (scores > least[:, None]))
                values, cells = scores[rows, cells], columns[cells]
            cuts = np.searchsorted(rows, np.arange(len(q) + 1))
            for r in np.unique(rows).tolist():
                a, b = cuts[r], cuts[r + 1]
                had = int((at[r] >= 0).sum())
                s = np.concatenate([best[r, :had], values[a:b]])
                j = np.concatenate([at[r, :had], lo + cells[a:b]])
                order = sorted(range(len(s)), key=lambda i, s=s: -s[i])[:k] if not exactly else np.argsort(-s, kind="stable")[:k]
                best[r, : len(order)], at[r, : len(order)] = s[order], j[order]
                if len(order) == k:
                    least[r] = max(least[r], float(best[r, k - 1]) * (1 if exactly else 1 - np.sign(float(best[r, k - 1])) * 1e-9))
        return best, at


_FOUND = "block long, query_id long, quid long, vec_id long, score long, envelope array<double>"
_FOUND_SCHEMA = pa.schema([*((c, pa.int64()) for c in ("block", "query_id", "quid", "vec_id", "score")), ("envelope", pa.list_(pa.float64()))])


@tidily
def _search(k: int, centroids: np.ndarray, envelopes: bool, tally: Accumulator | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, kind, uid, vec_id, q, mark) sorted by block and kind: a block's vectors (kind 0), then its queries. Yields each query's best, and each block's
    envelope if asked for, as a row of its own."""
    at, held, block = None, [], None

    def build() -> Block:
        d = max(centroids.shape[1], *(m.shape[1] for _, _, m in held))
        uids, ids, x = (np.concatenate(c) for c in ([u for u, _, _ in held], [v for _, v, _ in held], [_wide(m, d) for _, _, m in held]))
        return Block(uids, ids, x, centroids[at % len(centroids)])

    def ended() -> Iterator[pa.RecordBatch]:
        nonlocal block, held
        if envelopes and (block or held):
            block, held = block or build(), []
            yield pa.RecordBatch.from_arrays([pa.array([at]), *(pa.nulls(1, pa.int64()) for _ in range(4)), pa.array([envelope(block.f, block.c)], pa.list_(pa.float64()))], schema=_FOUND_SCHEMA)
        if block and tally is not None:
            tally.add(block.exact)

    for b in batches:
        code = b.column(0).to_numpy() * 2 + b.column(1).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
        for lo, hi in zip(edges, edges[1:]):
            if lo == hi:
                continue
            part, kind = b.slice(lo, hi - lo), int(code[lo]) % 2
            if code[lo] // 2 != at:
                yield from ended()
                at, held, block = int(code[lo]) // 2, [], None
            uids, ids, q = part.column(2).to_numpy(), part.column(3).to_numpy(), _matrix(part.column(4))
            if not kind:
                held.append((uids, ids, q))
                continue
            if block is None and held:
                block, held = build(), []
            marks = part.column(5).to_numpy(zero_copy_only=False)
            for o in range(0, len(ids) if block else 0, AT_ONCE):
                some = slice(o, o + AT_ONCE)
                best, at_ = block.search(uids[some], q[some], k, marks[some])
                rows, cells = np.nonzero(at_ >= 0)
                whole = [int(x) for x in best[rows, cells].tolist()]
                if any(not -(2**63) <= x < 2**63 for x in whole):
                    raise OverflowError("a score is larger than a long")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), at)), pa.array(ids[some][rows]), pa.array(uids[some][rows]), pa.array(block.ids[at_[rows, cells]]), pa.array(whole, pa.int64()), pa.nulls(len(rows), pa.list_(pa.float64()))],
                    schema=_FOUND_SCHEMA,
                )
    yield from ended()


@tidily
def _assign(centroids: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearest(centroids, _matrix(b.column(2))))], ["uid", "vec_id", "q", "cell"])


@tidily
def _route(centroids: np.ndarray, blocks: np.ndarray, envelopes: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """centroids are as wide as the widest vector. uid, vec_id, q, block, mark of queries -> a row for each other block that may hold a score that reaches the mark."""
    for b in batches:
        for o in range(0, b.num_rows, AT_ONCE):
            part = b.slice(o, AT_ONCE)
            q, marks = _matrix(part.column(2)).astype(float), part.column(4).to_numpy(zero_copy_only=False)
            bound = admits(_wide(q, centroids.shape[1]), centroids.astype(float)[blocks % len(centroids)], envelopes)
            rows, to = np.nonzero((bound >= marks[:, None]) & (blocks[None] != part.column(3).to_numpy()[:, None]))
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(blocks[to]), pa.array(np.ones(len(rows), np.int32)), *(part.column(i).take(at) for i in (0, 1, 2, 4))], ["block", "kind", "uid", "vec_id", "q", "mark"])


_READY = "block long, kind int, uid long, vec_id long, q array<long>, mark double"


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, tally: Accumulator | None = None) -> DataFrame:
    """query_id, rank, vec_id, score; queries are the rows whose vec_id is divisible by `every`. tally: counts the pairs whose scores were computed."""
    spark = vectors.sparkSession
    by_bytes(spark)
    rows = quantised(vectors)
    n, width = rows.agg(F.count("*"), F.max(F.size("q"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = [r["q"] for r in rows.orderBy(F.xxhash64("uid"), "uid").limit(min(CENTROIDS, max(1, n // ROWS_EACH))).select("q").collect()]
    centroids = np.array([q + [0] * (width - len(q)) for q in sample], np.int64).reshape(len(sample), width)
    cells = cut(rows.mapInArrow(functools.partial(_assign, centroids), "uid long, vec_id long, q array<long>, cell long"))
    size = max(BLOCK, math.ceil(n / ENVELOPES))
    counts = cells.groupBy("cell").count().collect()  # a row for each centroid
    parts = spark.createDataFrame([(r["cell"], math.ceil(r["count"] / size)) for r in counts], "cell long, parts long")
    # a block's number tells its centroid: the remainder by their number
    block = F.pmod(F.xxhash64("uid"), F.col("parts")) * len(centroids) + F.col("cell")
    placed = cells.join(F.broadcast(parts), "cell").select(block.alias("block"), F.lit(0).alias("kind"), "uid", "vec_id", "q", F.lit(float("-inf")).alias("mark"))
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = placed.where(F.col("vec_id") % every == 0).withColumn("kind", F.lit(1))

    def searched(queries: DataFrame, envelopes: bool) -> DataFrame:
        ready = placed.unionByName(queries).repartition(shuffle, "block").sortWithinPartitions("block", "kind")
        return ready.mapInArrow(functools.partial(_search, k, centroids, envelopes, tally), _FOUND)

    first = cut(searched(asked, True))
    shapes = first.where("envelope is not null").select("block", "envelope").collect()  # at most ENVELOPES and one for each centroid
    near = first.where("envelope is null")
    if len(shapes) > 1:
        marks = near.groupBy("quid").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("m"))
        queries = asked.drop("kind", "mark").join(marks, asked["uid"] == marks["quid"], "left").select("uid", "vec_id", "q", "block", F.coalesce("m", F.lit(float("-inf"))).alias("mark"))
        blocks, known = np.array([r["block"] for r in shapes], np.int64), np.array([r["envelope"] for r in shapes])
        sent = queries.mapInArrow(functools.partial(_route, centroids, blocks, known), _READY)
        near = near.unionByName(searched(sent, False))
    rank = F.row_number().over(Window.partitionBy("query_id", "quid").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
with v as (select row_number() over () u, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) q from embeddings
           where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.u, a.vec_id as query_id, b.vec_id as vec_id, list_inner_product(a.q, b.q)::bigint as score from v a join v b on a.vec_id % 50 = 0 and a.u <> b.u)
select query_id, rank, vec_id, score
from (select *, row_number() over (partition by u order by score desc, vec_id)::int as rank from s) where rank <= 5
"""
