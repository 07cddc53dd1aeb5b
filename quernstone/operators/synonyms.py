"""Groups of synonyms: a table (id, description, word) in which every word is in one group."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """Lines of ["description", ["word", ...]], gzipped or not."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    words = F.from_json(F.get_json_object("value", "$[1]"), "array<string>")
    return numbered(lines.select(F.get_json_object("value", "$[0]").alias("description"), words.alias("words")))


def numbered(groups: DataFrame) -> DataFrame:
    """(description, words) -> (id, description, word), words lower-cased. A word in several groups is an error."""
    rows = groups.select(F.xxhash64("description", "words").alias("id"), "description", F.explode("words").alias("word"))
    rows = rows.select("id", "description", F.lower("word").alias("word")).distinct()
    twice = rows.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['word']!r} is in several groups")
    return rows


def replaced(rows: DataFrame, path: str) -> DataFrame:
    """Writes the list in place of an earlier one."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.parquet(path)


def dump(rows: DataFrame) -> DataFrame:
    """One JSON line for each group, as read() takes them; words and groups sorted."""
    words = F.array_sort(F.collect_list("word"))
    each = rows.groupBy("id").agg(F.first("description").alias("d"), words.alias("w"))
    return each.select(F.concat(F.lit("["), F.to_json(F.array("d")).substr(F.lit(2), F.length(F.to_json(F.array("d"))) - 2), F.lit(","), F.to_json("w"), F.lit("]")).alias("line"))


def expand(rows: DataFrame, words: DataFrame) -> DataFrame:
    """(word, synonym): the other words of each word's group."""
    other = rows.select("id", F.col("word").alias("synonym"))
    return words.select("word").distinct().join(rows, "word").join(other, "id").where("word <> synonym").select("word", "synonym")


def lookup(rows: DataFrame, words: list[str]) -> dict[str, tuple[str, ...]]:
    """For the words of a query, as plans.search takes it."""
    found: dict[str, tuple[str, ...]] = {}
    spark = rows.sparkSession
    for r in expand(rows, spark.createDataFrame([(w,) for w in words], "word string")).orderBy("word", "synonym").collect() if words else []:
        found[r["word"]] = (*found.get(r["word"], ()), r["synonym"])
    return found
