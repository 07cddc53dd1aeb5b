"""Readers and writers: JSON documents, document lists with automatic ids, load-test sets, snapshots, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.text import compress_of, packed_of, uncompress_of
from quernstone.operators.maintain import assigned_ids

DOCUMENT = "id string, title string, text string, date timestamp"
LOAD_SET = "Iterations int, Spaces array<string>, Queries array<string>, Limit int, Offset int"


def read_documents(spark: SparkSession, path: str, space: str, auto_ids: bool = False, limit: int | None = None) -> DataFrame:
    """JSON lines {id, title, text, date}, gzipped or not, as documents. Dates before 1970 count as 1970. With auto_ids rows are numbered in order."""
    rows = spark.read.schema(DOCUMENT).json(path)
    rows = rows.limit(limit) if limit is not None else rows
    seconds = F.greatest(F.coalesce(F.unix_micros("date"), F.lit(0)), F.lit(0))
    docs = rows.select(
        F.lit(space).alias("space"), F.col("id").alias("doc_id"), (seconds * 1000).alias("updated"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("txt"), F.lit(True).alias("alive")
    )
    return assigned_ids(docs).select(*docs.columns) if auto_ids else docs


def served_documents(spark: SparkSession, path: str, now: int, limit: int | None = None) -> DataFrame:
    """{title, text, date} numbered from 0 in order; a missing date is now (nanoseconds)."""
    rows = spark.read.schema(DOCUMENT).json(path)
    rows = rows.limit(limit) if limit is not None else rows
    docs = rows.select(F.coalesce(F.unix_micros("date") * 1000, F.lit(now)).alias("updated"), "title", F.col("text").alias("txt"), F.lit(True).alias("alive"))
    return assigned_ids(docs)


def read_load_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOAD_SET).json(path, multiLine=True)


def write_results(results: DataFrame, path: str) -> None:
    """A load test's raw results: seconds, duration, status."""
    results.select("seconds", "duration", "status").write.mode("overwrite").csv(path)


def write_documents(docs: DataFrame, path: str, mode: str = "overwrite", codec: str = "zstd", packed: bool = False) -> DataFrame:
    """Documents by space. The file codec compresses texts; `packed` also stores each as a compressed blob of its own."""
    docs = docs.withColumn("txt", compress_of("txt")) if packed else docs
    docs.write.mode(mode).option("compression", codec).partitionBy("space").parquet(path)
    return docs.sparkSession.read.schema(docs.schema).parquet(path)  # else a space such as 01 would come back as a number


def read_packed(docs: DataFrame) -> DataFrame:
    """Documents whose texts may be blobs, with plain texts."""
    return docs.withColumn("txt", uncompress_of("txt"))


def pack_rows(docs: DataFrame) -> DataFrame:
    """Documents whose texts are blobs, those that aren't yet compressed."""
    return docs.withColumn("txt", packed_of(F.col("txt").cast("binary")))


def compact(spark: SparkSession, path: str, to: str, files: int) -> None:
    """Rewrites a table into fewer files."""
    spark.read.parquet(path).coalesce(files).write.mode("overwrite").parquet(to)


def vocabulary_instances(postings: DataFrame) -> DataFrame:
    """One row for each occurrence of a term: term, id, col, off."""
    return postings.select("term", "id", "col", "off")


def json_values(spark: SparkSession, text: str) -> DataFrame:
    """The strings of a JSON array, one a row."""
    return spark.createDataFrame([(text,)], "x string").select(F.explode(F.from_json("x", "array<string>")).alias("value"))
