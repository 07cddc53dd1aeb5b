"""The spelling dictionary and fuzzy search in it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.functions import spelling
from quernstone.operators.index import Index
from quernstone.plans.parse import Phrase

SCOPE, TOP, HASH, LEAST_CHARS, LEAST_COUNT, MOST_LAG = 3, 20, 30, 3, 5, 100


def dictionary(vocabulary: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, rank (occurrences), k1 (ASCII form), k2 (its phonetic hash) of terms that are long and frequent enough."""
    words = vocabulary.where((F.length("term") > LEAST_CHARS) & (F.col("cnt") >= least_count))
    k1 = words.select(F.col("term").alias("word"), F.col("cnt").alias("rank"), F.lower(spelling.translit_of("term")).alias("k1"))
    return k1.withColumn("k2", spelling.phonehash_of("k1"))


def save_dictionary(words: DataFrame, path: str) -> DataFrame:
    """Sorted by hash, so that a lookup's range of hashes is a few row groups."""
    words.repartitionByRange("k2").sortWithinPartitions("k2").write.mode("overwrite").parquet(path)
    return words.sparkSession.read.parquet(path)


def lag(vocabulary: DataFrame, words: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """One row: how many terms qualify for the dictionary beyond those that it has; beyond MOST_LAG it should be made anew."""
    able = vocabulary.where((F.length("term") > LEAST_CHARS) & (F.col("cnt") >= least_count)).agg(F.count("*").alias("vocab_words"))
    made = able.withColumn("dictionary_words", words.agg(F.count("*")).scalar())
    return made.withColumn("lag", F.col("vocab_words") - F.col("dictionary_words")).withColumn("stale", F.col("lag") >= MOST_LAG)


def _scope(hashed: str) -> str:
    n = len(hashed[: HASH - 2])
    return hashed[: SCOPE if n > SCOPE else (n - 1 if n > 2 else n)]


def similar(words: DataFrame, patterns: list[str], top: int = TOP, most_distance: int | None = None) -> DataFrame:
    """pattern, word, distance, score, place: for each pattern the `top` nearest words among those whose hash begins like its own. The patterns
    make one filter on k2 that the scan takes; words and patterns meet by their hash's beginning."""
    spark = words.sparkSession
    rows = [(p, a, _scope(spelling.phonehash(a) or "")) for p in dict.fromkeys(patterns) for a in [spelling.translit(p).lower()]]
    asked = spark.createDataFrame([(*r, len(r[2])) for r in rows], "pattern string, ascii string, block string, n int")
    found = None
    for n in sorted({len(r[2]) for r in rows}):
        blocks = sorted({r[2] for r in rows if len(r[2]) == n})
        some = words.where(F.substring("k2", 1, n).isin(*blocks)).withColumn("block", F.substring("k2", 1, n))
        some = some.join(F.broadcast(asked.where(F.col("n") == n)), "block")
        found = some if found is None else found.unionByName(some)
    distance = found.withColumn("distance", spelling.editdist_of(F.col("ascii"), F.col("k1"))).where("distance >= 0")
    if most_distance is not None:
        distance = distance.where(F.col("distance") <= most_distance)
    scored = distance.withColumn("score", spelling.score_of(F.col("distance"), F.col("rank")))
    place = F.row_number().over(Window.partitionBy("pattern").orderBy("score", "distance", "word"))
    return scored.withColumn("place", place).where(F.col("place") <= top).select("pattern", "word", "distance", "score", "place")


def corrected(index: Index, words: DataFrame, phrases: list[Phrase], stopwords: set[str] = frozenset()) -> tuple[list[Phrase], int, bool]:
    """Phrases of one word that no document has, replaced by the nearest word; the sum of distances; whether anything was replaced."""
    single = [p.text for p in phrases if " " not in p.text and p.text not in stopwords]
    terms = {t: (index.analyser.words(t) or [t])[0] for t in single}
    if not terms:
        return phrases, 0, False
    known = {r[0] for r in index.vocabulary().where(F.col("term").isin(*terms.values())).select("term").collect()}
    missing = [t for t in single if terms[t] not in known]
    if not missing:
        return phrases, 0, False
    best = {r["pattern"]: r for r in similar(words, missing, top=1).collect()}
    out = [replace(p, text=best[p.text]["word"]) if p.text in best and " " not in p.text else p for p in phrases]
    return out, sum(best[p.text]["distance"] for p in phrases if p.text in best), bool(best)
