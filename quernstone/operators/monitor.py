"""Status of workers, metrics over time, reports of load tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions.text import compatible

IN_SYNC, SYNCING, STARTING, INCOMPLETE, INCOMPATIBLE = range(72, 77)
STALE_S, DROPPED_S = 30, 600


def latest_by(rows: DataFrame, key: str, time: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(time, *(c for c in rest if c != time))).alias("x")).select(key, "x.*")


def alive(statuses: DataFrame, now: Column, time: str = "ts", key: str = "worker", stale_s: int = STALE_S) -> DataFrame:
    """The last status of each worker, with `stale`; workers not heard of for DROPPED_S are gone."""
    last = latest_by(statuses, key, time)
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col(time).cast("timestamp"))
    return last.withColumn("age_s", age).where(F.col("age_s") < DROPPED_S).withColumn("stale", F.col("age_s") > stale_s)


def group_status(workers: DataFrame, size: int, version: str, started: bool = True, pending: int = 0) -> DataFrame:
    """One row, the group's status: the worst of what its workers (shard, version, stale) show."""
    live = workers.where("not stale")
    seen = live.agg(F.count_distinct("shard").alias("shards"), F.coalesce(F.bool_or(~compatible(F.col("version"), F.lit(version))), F.lit(False)).alias("odd"))
    status = F.greatest(
        F.lit(IN_SYNC if started else STARTING),
        F.lit(SYNCING if pending else IN_SYNC),
        F.when(F.col("shards") < size, INCOMPLETE).otherwise(IN_SYNC),
        F.when(F.col("odd"), INCOMPATIBLE).otherwise(IN_SYNC),
    )
    return seen.select(status.alias("status"), "shards")


def windows(metrics: DataFrame, period: str, how: str = "avg", time: str = "ts", value: str = "value", keys: tuple[str, ...] = (), since: Column | None = None) -> DataFrame:
    """A metric by tumbling periods: avg, sum, or delta (the last value less the first). `since`: the age beyond which values are dropped."""
    if since is not None:
        metrics = metrics.where(F.col(time) >= since)
    v, t = F.col(value), F.col(time)
    made = {"avg": F.avg(v), "sum": F.sum(v), "delta": F.max_by(v, t) - F.min_by(v, t)}[how]
    return metrics.groupBy(F.window(t, period).alias("w"), *keys).agg(made.alias(how)).select(F.col("w.start").alias("start"), *keys, how)


def load_report(results: DataFrame, column: str = "seconds", keys: tuple[str, ...] = ()) -> DataFrame:
    """Of a load test's results (status 'ok' or another): n, mean, median, p90, p95, p99, success ratio. A percentile is the value at place
    floor(n * p), from 0, of the sorted list; equal values are counted before anything is sorted."""
    per_value = results.groupBy(*keys, column).agg(F.count("*").alias("c"), F.count_if(F.col("status") == "ok").alias("good"))
    line = Window.partitionBy(*keys)
    counted = per_value.withColumn("upto", F.sum("c").over(line.orderBy(column))).withColumn("n", F.sum("c").over(line))
    place = lambda p: F.min(F.when(F.col("upto") > F.floor(F.col("n") * p), F.col(column)))
    return counted.groupBy(*keys).agg(
        F.max("n").alias("n"), (F.sum(F.col(column) * F.col("c")) / F.max("n")).alias("mean"), place(0.5).alias("median"), place(0.9).alias("p90"), place(0.95).alias("p95"), place(0.99).alias("p99"), (F.sum("good") / F.max("n")).alias("success")
    )


def loaded(docs: DataFrame, seconds: float) -> DataFrame:
    """Bytes of a bulk load and its rate in MB (10^6 bytes) a second."""
    size = F.coalesce(F.sum(F.octet_length("title") + F.octet_length("txt")), F.lit(0))
    return docs.agg(size.alias("bytes"), (size / 1e6 / F.lit(seconds)).alias("mb_per_s"))
