"""Keeping documents up to date: upserts where the last arrival wins, soft deletion, paging by key, the work list of wanted documents
(interest list) with its cursor, the result cache."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENDING, REQUESTED, SERVED = 0, 1, 2
OUTSTANDING, REQUEST, REFETCH_S, EXPIRE_S, FUTURE_NS = 4, 50, 3, 30, 5 * 60 * 10**9


def latest(updates: DataFrame, *order: str, key: tuple[str, ...] = ("space", "doc_id")) -> DataFrame:
    """The last update of each document by `order` (arrival: batch, then place in it), without those columns; a deleted one without its texts."""
    rest = [c for c in updates.columns if c not in (*key, *order)]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("x")
    rows = updates.groupBy(*key).agg(last).select(*key, *(F.col(f"x.{c}").alias(c) for c in rest))
    texts = {c: F.when(F.col("alive"), F.col(c)).otherwise(F.lit("")) for c in ("title", "txt") if c in rest}
    return rows.withColumns(texts) if texts and "alive" in rest else rows


def upsert(docs: DataFrame, updates: DataFrame, key: tuple[str, ...] = ("space", "doc_id")) -> DataFrame:
    """docs with updates in place of what they replace."""
    return docs.join(updates.select(*key), list(key), "left_anti").unionByName(updates)


def not_future(refs: DataFrame, now: int, column: str = "updated") -> DataFrame:
    """Without references that are dated more than five minutes ahead."""
    return refs.where(F.col(column) <= now + FUTURE_NS)


def keyset_page(docs: DataFrame, after: tuple[int, str] | None, limit: int, by: tuple[str, str] = ("updated", "doc_id")) -> DataFrame:
    """The next page in the order of (time, id) after a position."""
    if after:
        a, b = (F.col(c) for c in by)
        docs = docs.where((a >= after[0]) & ((a > after[0]) | (b > after[1])))  # the first part is what a scan can use
    return docs.orderBy(*by).limit(limit)


def split_wanted(refs: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wanted, present): references whose document of that version isn't, or is, in docs."""
    key = ["space", "doc_id", "updated"]
    have = docs.select(*key)
    return refs.join(have, key, "left_anti"), refs.join(have, key, "left_semi")


def unique_keys(docs: DataFrame, key: tuple[str, ...] = ("space", "doc_id")) -> None:
    """Raises if a key repeats or a column is null: what a writer of documents has to hold to."""
    bad = docs.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if bad:
        raise ValueError(f"repeated document {bad[0]}")
    nulls = docs.select(*(F.count_if(F.col(c).isNull()).alias(c) for c in docs.columns)).first().asDict()
    if any(nulls.values()):
        raise ValueError(f"nulls in {[c for c, n in nulls.items() if n]}")


# The interest list: (space, doc_id, updated, state, requested_at)


def new_list(current: DataFrame, refs: DataFrame, space: str, spaces: tuple[str, ...] | None = None) -> DataFrame:
    """The list with `refs` as a space's new work; an earlier list of the space must be served. With `spaces`, the space must be one of them."""
    if spaces is not None and space not in spaces:
        raise ValueError(f"no such space: {space}")
    if current.where((F.col("space") == space) & (F.col("state") != SERVED)).limit(1).count():
        raise ValueError("the interest list isn't served yet")
    fresh = refs.select(F.lit(space).alias("space"), "doc_id", "updated", F.lit(PENDING).alias("state"), F.lit(None).cast("double").alias("requested_at"))
    return current.where(F.col("space") != space).unionByName(fresh)


def serve(current: DataFrame, served: DataFrame) -> DataFrame:
    """Marks documents as served."""
    done = served.select("space", "doc_id").distinct().withColumn("__done", F.lit(True))
    state = F.when(F.col("__done"), SERVED).otherwise(F.col("state"))
    return current.join(done, ["space", "doc_id"], "left").withColumn("state", state).drop("__done").select(*current.columns)


def states(current: DataFrame) -> DataFrame:
    """Counts by space: pending, requested, served."""
    return current.groupBy("space").agg(*(F.count_if(F.col("state") == k).alias(n) for k, n in ((PENDING, "pending"), (REQUESTED, "requested"), (SERVED, "served"))))


def timed_out(current: DataFrame, now: float, listed_at: float) -> DataFrame:
    """What was requested too long ago is pending again; a list that is too old counts its requested documents as served."""
    late = (F.col("state") == REQUESTED) & (F.col("requested_at") <= now - REFETCH_S)
    state = F.when((F.col("state") == REQUESTED) & F.lit(now - listed_at > EXPIRE_S), SERVED).when(late, PENDING).otherwise(F.col("state"))
    return current.withColumn("state", state.cast("int"))


def to_request(current: DataFrame, space: str) -> DataFrame:
    """The next documents to ask for: at most REQUEST, and no more than OUTSTANDING requests' worth in all."""
    counts = states(current.where(F.col("space") == space)).first()
    n = min(counts["pending"], max(0, OUTSTANDING * REQUEST - counts["requested"]), REQUEST) if counts else 0
    return current.where((F.col("space") == space) & (F.col("state") == PENDING)).orderBy("updated", "doc_id").limit(n)


def cursor(docs: DataFrame, current: DataFrame, listed_at: Column | int) -> DataFrame:
    """space, updated, doc_id: the last served document of each space, by (updated, id), not newer than the list."""
    done = current.where(F.col("state") == SERVED).select("space", "doc_id")
    at = listed_at if isinstance(listed_at, Column) else F.lit(listed_at)
    served = docs.join(done, ["space", "doc_id"], "left_semi").where(F.col("updated") <= at)
    return served.groupBy("space").agg(F.max(F.struct("updated", "doc_id")).alias("x")).select("space", "x.updated", "x.doc_id")


def assigned_ids(docs: DataFrame, first: int = 0) -> DataFrame:
    """Numbers rows in their order as their doc_id (loading with automatic ids): two passes, no partition holds all rows."""
    plain = docs.drop("doc_id")
    rows = plain.rdd.zipWithIndex().map(lambda x: (*x[0], str(x[1] + first)))
    return docs.sparkSession.createDataFrame(rows, plain.schema.add("doc_id", "string"))


def cursor_of(cursors: DataFrame, space: str, spaces: tuple[str, ...]) -> tuple[int, str]:
    """A space's cursor; (0, '') before anything was served."""
    if space not in spaces:
        raise ValueError(f"no such space: {space}")
    row = cursors.where(F.col("space") == space).first()
    return (row["updated"], row["doc_id"]) if row else (0, "")


class ResultCache:
    """Results of searches by their canonical query; entries age out, and the oldest go when there are too many."""

    def __init__(self, most_bytes: int = 250 << 20, max_age_s: float = 600, clock: Callable[[], float] = time.monotonic):
        self.most, self.age, self.clock, self.size = most_bytes, max_age_s, clock, 0
        self.kept: OrderedDict[tuple, tuple[float, int, list]] = OrderedDict()

    def get(self, key: tuple) -> list | None:
        got = self.kept.get(key)
        if got and self.clock() - got[0] > self.age:
            self._drop(key)
            got = None
        return got[2] if got else None

    def put(self, key: tuple, rows: list) -> None:
        if key in self.kept:
            self._drop(key)
        n = sum(len(str(r)) for r in rows) + 64
        self.kept[key] = (self.clock(), n, rows)
        self.size += n
        while self.size > self.most:
            self._drop(next(iter(self.kept)))

    def forget(self, doc_ids: set[str], column: str = "id") -> None:
        """Drops the results that show any of the documents."""
        for key in [k for k, (_, _, rows) in self.kept.items() if any(r[column] in doc_ids for r in rows)]:
            self._drop(key)

    def _drop(self, key: tuple) -> None:
        self.size -= self.kept.pop(key)[1]
