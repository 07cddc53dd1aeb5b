"""python -m quernstone COMMAND: load, search, stats, check, rebuild, sql, synonyms, spelling, stopwords, env."""

from __future__ import annotations

import argparse
import sys

from quernstone.api import SearchAgent
from quernstone.config import Config
from quernstone.operators import index as ix
from quernstone.operators import sharding, spell, synonyms
from quernstone.session import local_session
from quernstone.sources import files


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession() or local_session("*")


def load(a) -> None:
    config = Config.from_env()
    docs = files.read_documents(_spark(), a.json, a.space, a.auto, a.limit)
    mine = sharding.only(docs, config.shard_index, config.shard_size)
    from pyspark.sql import functions as F

    ix.Index.of(mine.withColumn("id", F.monotonically_increasing_id()), config.analyser()).save(a.index)


def search(a) -> None:
    found = SearchAgent(ix.Index.open(_spark(), a.index), Config.from_env()).search(a.query, a.space, a.limit, a.page)
    print(f"{found.status}: {found.total} hits{' (capped)' if found.capped else ''} in {found.seconds:.2f} s")
    for h in found.hits:
        print(f"{h['rank']:.4f}  {h['space']}/{h['id']}  {h['snippet']}")
    if found.respelt:
        print(f"Did you mean {found.respelt}?")


def stats(a) -> None:
    index = ix.Index.open(_spark(), a.index)
    index.stats().show()
    index.per_space().show()
    index.top_terms().show()


def check(a) -> None:
    wrong = ix.Index.open(_spark(), a.index).check()
    n = wrong.count()
    wrong.show()
    sys.exit(n > 0)


def rebuild(a) -> None:
    ix.Index.open(_spark(), a.index).rebuild().save(a.to)


def sql(a) -> None:
    spark = _spark()
    index = ix.Index.open(spark, a.index)
    for name in ("docs", "postings", "texts"):
        getattr(index, name).createOrReplaceTempView(name)
    text = open(a.statement[1:]).read() if a.statement.startswith("@") else a.statement
    for row in spark.sql(text, args=a.args).toLocalIterator():
        print(", ".join("NULL" if x is None else str(x) for x in row))


def synonym_list(a) -> None:
    spark = _spark()
    if a.json:
        synonyms.replaced(synonyms.read(spark, a.json), f"{a.index}/synonyms")
    else:
        for r in synonyms.dump(spark.read.parquet(f"{a.index}/synonyms")).toLocalIterator():
            print(r["line"])


def spelling(a) -> None:
    index = ix.Index.open(_spark(), a.index)
    spell.save_dictionary(spell.dictionary(index.vocabulary(), a.least), f"{a.index}/dictionary")


def stop(a) -> None:
    for r in ix.stopwords(ix.Index.open(_spark(), a.index).vocabulary(), Config.from_env().stopword_cutoff / 100).collect():
        print(r["word"], r["cnt"])


def env(a) -> None:
    for k, v in vars(Config.from_env()).items():
        print(f"QUERNSTONE_{k.upper()}={','.join(v) if isinstance(v, tuple) else v}")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="quernstone", description=__doc__)
    commands = p.add_subparsers(required=True)

    def add(name, f, *more):
        c = commands.add_parser(name)
        for flags, kw in more:
            c.add_argument(*flags, **kw)
        c.set_defaults(run=f)

    index = (("index",), {})
    add("load", load, index, (("space",), {}), (("json",), {}), (("-a", "--auto"), {"action": "store_true"}), (("-m", "--limit"), {"type": int}))
    add("search", search, index, (("query",), {}), (("-s", "--space"), {"action": "append"}), (("-l", "--limit"), {"type": int, "default": 10}), (("-p", "--page"), {"type": int, "default": 0}))
    add("stats", stats, index)
    add("check", check, index)
    add("rebuild", rebuild, index, (("to",), {}))
    add("sql", sql, index, (("statement",), {}), (("args",), {"nargs": "*"}))
    add("synonyms", synonym_list, index, (("json",), {"nargs": "?"}))
    add("spelling", spelling, index, (("--least",), {"type": int, "default": spell.LEAST_COUNT}))
    add("stopwords", stop, index)
    add("env", env)
    a = p.parse_args(args)
    a.run(a)


if __name__ == "__main__":
    main()
