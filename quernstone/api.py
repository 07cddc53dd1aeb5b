"""The engine as an application uses it: SearchAgent answers queries, DocumentManager takes documents in."""

from __future__ import annotations

import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.config import Config
from quernstone.operators import spell, synonyms
from quernstone.operators.index import Index, stopwords
from quernstone.operators.maintain import ResultCache
from quernstone.operators.segments import Segments
from quernstone.operators.sharding import only
from quernstone.plans import parse as language
from quernstone.plans import search as plan
from quernstone.streaming.index_stream import DocumentTable


@dataclass(frozen=True)
class Response:
    hits: tuple[dict, ...] = ()
    status: str = plan.NO_HIT
    total: int = 0
    total_raw: int = 0
    capped: bool = False
    respelt: str = ""
    respelt_distance: int = 0
    cached: bool = False
    seconds: float = 0.0


class SearchAgent:
    """Answers queries over an index: parsed, reduced and put in canonical order, looked up in the cache, searched; a query without hits is
    respelt, and with autocorrect searched again."""

    def __init__(self, index: Index, config: Config | None = None, words: DataFrame | None = None, groups: DataFrame | None = None, stop: set[str] | None = None):
        self.index, self.config, self.words, self.groups = index, config or Config(), words, groups
        self._stop = stop
        self.cache = ResultCache(self.config.cache_mb << 20, self.config.cache_seconds)

    @property
    def stopwords(self) -> set[str]:
        if self._stop is None:
            self._stop = {r["word"] for r in stopwords(self.index.vocabulary(), self.config.stopword_cutoff / 100).collect()}
        return self._stop

    def search(self, query: str, spaces: list[str] | None = None, limit: int = 10, page: int = 0, autocorrect: bool = False) -> Response:
        began = time.monotonic()
        phrases = language.canonical(language.reduce(language.parse(query)))
        key = (tuple(map(str, phrases)), tuple(sorted(spaces or ())), language.clamp(limit), page, autocorrect)
        kept = self.cache.get(key)
        if kept is not None:
            return replace(kept[0]["response"], cached=True, seconds=time.monotonic() - began)
        found = self._run(phrases, spaces, limit, page)
        if found.status == plan.NO_HIT and self.words is not None and phrases:
            fixed, distance, changed = spell.corrected(self.index, self.words, phrases, self.stopwords)
            if changed:
                again = self._run(fixed, spaces, limit, page) if autocorrect else found
                found = replace(again, respelt=" ".join(map(str, fixed)), respelt_distance=distance)
        # one row for each document that is shown, so that changed documents can be forgotten
        self.cache.put(key, [{"response": found, "id": h["id"]} for h in found.hits] or [{"response": found, "id": None}])
        return replace(found, seconds=time.monotonic() - began)

    def forget(self, doc_ids: set[str]) -> None:
        """Drops cached results that show any of the documents."""
        self.cache.forget(doc_ids)

    def _run(self, phrases: list[language.Phrase], spaces: list[str] | None, limit: int, page: int) -> Response:
        words = [w for p in phrases for w in p.text.split()]
        others = synonyms.lookup(self.groups, words) if self.groups is not None else {}
        status = plan.status_of(plan.parts(self.index, phrases, self.stopwords, others))
        if status != plan.OK:
            return Response(status=status)
        rows = plan.search(self.index, phrases, spaces, limit, page, self.config.result_cap, self.config.snippet, True, self.stopwords, others).collect()
        if not rows:
            return Response()
        hits = tuple({k: r[k] for k in ("space", "id", "rank", "snippet")} for r in rows)
        return Response(hits, plan.OK, rows[0]["total"], rows[0]["total_raw"], rows[0]["capped"])


class DocumentManager:
    """Takes documents in, in batches: other shards' documents are left out, the last update of each wins, and each batch becomes a segment of the index."""

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None):
        self.spark, self.config, self.path = spark, config or Config(), path.rstrip("/")
        self.table = DocumentTable(spark, f"{self.path}/docs")
        self.segments = Segments(spark, f"{self.path}/index", self.config.analyser())
        self.batch = self.segments.batches

    def add(self, docs: DataFrame) -> None:
        """A batch of documents: space, doc_id, updated, title, txt, alive. Those of spaces that aren't configured are left out."""
        mine = only(docs.where(F.col("space").isin(*self.config.spaces)), self.config.shard_index, self.config.shard_size)
        self.table.write(mine, self.batch, "updated")
        self.batch += 1

    def index(self) -> Index:
        """Indexes the batches that aren't yet and returns the index. Ids follow the order of writing; a document that is updated keeps its own."""
        for k in range(self.segments.batches, self.batch):
            self.segments.add(self.spark.read.parquet(f"{self.path}/docs/data/batch={k}"), "version")
        return self.segments.open()

    def optimise(self) -> Index:
        """Merges the index's segments into one, and deletes the others."""
        self.segments.merge()
        self.segments.sweep()
        return self.segments.open()


def run_load(agent: SearchAgent, load_set: DataFrame, seed: int = 0) -> DataFrame:
    """Runs load sets (Iterations, Spaces, Queries, Limit, Offset) against an agent, a random query each time: seconds, duration, status of each
    iteration, for operators.monitor.load_report."""
    import random

    rng = random.Random(seed)
    rows = []
    for s in load_set.collect():
        for _ in range(s["Iterations"] or 0):
            began = time.monotonic()
            found = agent.search(rng.choice(s["Queries"]), s["Spaces"], s["Limit"] or 10, s["Offset"] or 0)
            ok = found.status in (plan.OK, plan.NO_HIT)
            rows.append((time.monotonic() - began, found.seconds, "ok" if ok else found.status))
    return agent.index.docs.sparkSession.createDataFrame(rows, "seconds double, duration double, status string")
