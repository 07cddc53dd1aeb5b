"""An index that grows by batches: each batch of documents becomes a segment, a saved index of its own, and nothing that was there before is read again
to be tokenised or written. A document that comes again keeps its id, and what older segments hold of it is dead.

Segments are folders seg-<from>-<to> of the batches they hold; one counts from the moment its totals are written, the last part of it. A merge writes a
segment of all batches, after which the narrower ones no longer count; so readers and an interrupted writer find a whole index at any time."""

from __future__ import annotations

import re
from functools import reduce as fold

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators.index import Analyser, Index
from quernstone.operators.maintain import latest
from quernstone.session import cut, delete

#: Rows of (id, segment) that are broadcast at most, 16 MB; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


class Segments:
    def __init__(self, spark: SparkSession, path: str, analyser: Analyser | None = None):
        self.spark, self.path, self.analyser = spark, path.rstrip("/"), analyser or Analyser()

    def _all(self) -> list[tuple[int, int]]:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        found = jvm.org.apache.hadoop.fs.Path(f"{self.path}/seg-*/totals/_SUCCESS")
        names = [str(x.getPath()) for x in found.getFileSystem(conf).globStatus(found) or ()]
        return [(int(m[1]), int(m[2])) for n in names if (m := re.search(r"/seg-(\d+)-(\d+)/totals/", n))]

    def current(self) -> list[tuple[int, int]]:
        """The segments that count, oldest first: the widest that end where the next one begins."""
        every, out = self._all(), []
        upto = max((b for _, b in every), default=0)
        while upto > 0:
            first = min((a for a, b in every if b == upto), default=None)
            if first is None:
                raise ValueError(f"batch {upto} of {self.path} has no segment")
            out.append((first, upto))
            upto = first - 1
        return out[::-1]

    def _folder(self, segment: tuple[int, int]) -> str:
        return f"{self.path}/seg-{segment[0]}-{segment[1]}"

    @property
    def batches(self) -> int:
        return max((b for _, b in self._all()), default=0)

    def add(self, docs: DataFrame, order: str = "updated") -> int:
        """Makes a segment of a batch (space, doc_id, updated, title, txt, alive), of which each document's last row by `order` counts. Only the batch is
        tokenised. Returns the batch's number."""
        docs = latest(docs.select("space", "doc_id", "updated", "title", "txt", "alive", F.col(order).alias("__order")), "__order").drop("__order")
        batch = self.batches + 1
        if batch == 1:
            numbered = docs.withColumn("id", F.monotonically_increasing_id())
        else:
            known = self.open().docs.select("space", "doc_id", F.col("id").alias("__old"))
            first = (known.agg(F.max("__old")).first()[0] or 0) + 1
            found = docs.join(known, ["space", "doc_id"], "left")
            numbered = found.withColumn("id", F.coalesce("__old", F.monotonically_increasing_id() + F.lit(first))).drop("__old")
        Index.of(cut(numbered.select("id", "space", "doc_id", "updated", "title", "txt", "alive")), self.analyser).save(self._folder((batch, batch)))
        return batch

    def open(self) -> Index:
        """All segments as one index: later segments win."""
        found = [(b, Index.open(self.spark, self._folder((a, b)), self.analyser)) for a, b in self.current()]
        if not found:
            raise ValueError(f"{self.path} has no segment")
        if len(found) == 1:
            return found[0][1]
        union = lambda part: fold(DataFrame.unionByName, [getattr(i, part).withColumn("seg", F.lit(b)) for b, i in found])
        docs, postings, texts = union("docs"), union("postings"), union("texts")
        replaced = cut(docs.groupBy("id").agg(F.max("seg").alias("last"), F.count("*").alias("n")).where("n > 1").select("id", "last"))
        replaced = F.broadcast(replaced) if replaced.count() <= BROADCAST_ROWS else replaced
        live = lambda rows: rows.join(replaced, "id", "left").where("last is null or seg = last").drop("seg", "last")
        dead = postings.join(replaced, "id").where("seg < last").groupBy("seg", "term", "id").agg(F.count("*").alias("n"))
        gone = dead.groupBy("term").agg((-F.count("*")).alias("doc"), (-F.sum("n")).alias("cnt"))
        every = fold(DataFrame.unionByName, [i.vocabulary() for _, i in found]).unionByName(gone)
        vocabulary = every.groupBy("term").agg(F.sum("doc").alias("doc"), F.sum("cnt").alias("cnt")).where("cnt > 0")
        return Index(live(docs), live(postings), live(texts), self.analyser, kept_vocabulary=vocabulary)

    def merge(self) -> None:
        """Writes all segments as one, without the dead; texts aren't tokenised again."""
        now = self.current()
        if len(now) > 1:
            self.open().save(self._folder((now[0][0], now[-1][1])))

    def sweep(self) -> None:
        """Deletes segments that no longer count, once nothing reads them."""
        for s in set(self._all()) - set(self.current()):
            delete(self.spark, self._folder(s))
