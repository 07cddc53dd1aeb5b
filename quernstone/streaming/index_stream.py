"""Documents, metrics and statuses as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quernstone.functions.text import shard_of
from quernstone.operators.maintain import FUTURE_NS, latest
from quernstone.session import shared_dir


class DocumentTable:
    """Documents as versions in Parquet: each batch of a stream writes the rows that it changes under its own number, and a read takes each document's
    row of the highest number: the last to arrive. With by_order it is the row of the highest order, whenever it arrived. A batch that is repeated writes the
    same folder again, so a restart changes nothing. compact() folds versions into one."""

    def __init__(self, spark: SparkSession, path: str | None = None, key: tuple[str, ...] = ("space", "doc_id"), by_order: bool = False):
        self.spark, self.key, self.by_order = spark, key, by_order
        self.path = path or f"{shared_dir(spark).rstrip('/')}/docs-{uuid.uuid4().hex}"

    def write(self, updates: DataFrame, batch: int, order: str) -> None:
        latest(updates.withColumns({"version": F.col(order).cast("long"), "__n": F.col(order)}), "__n", key=self.key).write.mode("overwrite").parquet(f"{self.path}/data/batch={batch}")

    def read(self) -> DataFrame:
        return self._versions().drop("version")

    def _versions(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.path}/data").withColumn("n", F.col("version"))
        return latest(rows, *(("n", "batch") if self.by_order else ("batch", "n")), key=self.key)

    def compact(self, batch: int) -> DocumentTable:
        other = DocumentTable(self.spark, key=self.key, by_order=self.by_order)
        self._versions().write.mode("overwrite").parquet(f"{other.path}/data/batch={batch}")
        return other


def follow(updates: DataFrame, to: DocumentTable, order: str, now: int | None = None, shard: tuple[int, int] | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Starts the stream of updates into the table: other shards' documents and those dated in the future are left out, then each
    document's last update of a batch (by `order`) is written."""
    if shard:
        updates = updates.where(shard_of(F.col("doc_id"), shard[1]) == shard[0])
    if now is not None:
        updates = updates.where(F.col("updated") <= now + FUTURE_NS)
    writer = updates.writeStream.foreachBatch(lambda df, k: to.write(df, k, order)).option("checkpointLocation", checkpoint or f"{to.path}/checkpoint")
    return writer.trigger(availableNow=True).start()


def metric_stream(metrics: DataFrame, period: str, late: str, how: str = "avg", time: str = "ts", value: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """A metric by tumbling periods over event time; a period is final once the watermark has passed it."""
    t, v = F.col(time), F.col(value)
    made = {"avg": F.avg(v), "sum": F.sum(v), "delta": F.max_by(v, t) - F.min_by(v, t)}[how]
    return metrics.withWatermark(time, late).groupBy(F.window(t, period).alias("w"), *keys).agg(made.alias(how)).select(F.col("w.start").alias("start"), *keys, how)


def to_table(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and returns what it wrote."""
    path = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", f"{path}/data").outputMode("append")
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{path}/data"))
    query = writer.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{path}/data")


def latest_stream(statuses: DataFrame, key: str, time: str, late: str = "10 minutes") -> DataFrame:
    """The last status of each worker, kept up to date (update or complete mode)."""
    rest = [c for c in statuses.columns if c != key]
    return statuses.withWatermark(time, late).groupBy(key).agg(F.max_by(F.struct(*rest), time).alias("x")).select(key, "x.*")
