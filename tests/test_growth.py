"""Steps whose cost mustn't grow faster than their input."""

import random

import pytest

from quernstone import queries
from quernstone.operators.index import Index
from quernstone.plans import parse
from quernstone.plans import search as plan

SCHEMA = "id long, space string, doc_id string, updated long, title string, txt string, alive boolean"
ROWS = [(1, "s", "a", 1, "red bike", "the red bike", True), (2, "s", "b", 2, "", "the blue road", True), (3, "s", "c", 3, "", "", False)]


@pytest.mark.parametrize("query", ["red", "the red", '"the red" -blue'])
def test_occurrences_are_added_up_by_hash(spark, query):
    wanted = plan.parts(Index.of(spark.createDataFrame(ROWS, SCHEMA)), parse.reduce(parse.parse(query)))
    index = Index.of(spark.createDataFrame(ROWS, SCHEMA))
    found = plan.matches(index, wanted)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert [(r["id"], r["col"], r["off"]) for r in found.collect() if r["id"] == 1] == [(1, 0 if query == "red" else 1, 0)]


def test_the_check_shuffles_terms(spark):
    index = Index.of(spark.createDataFrame(ROWS, SCHEMA))
    broken = Index(index.docs, index.postings.where("not (term = 'red' and col = 1)").unionByName(index.postings.where("term = 'road'")), index.texts)
    assert sorted((r["side"], r["id"], r["col"], r["off"], r["term"]) for r in broken.check().collect()) == [("extra", 2, 1, 2, "road"), ("missing", 1, 1, 1, "red")]
    lost = Index(index.docs.where("id <> 2"), index.postings, index.texts)
    assert {(r["side"], r["id"]) for r in lost.check().collect()} == {("extra", 2)} and index.check().isEmpty()
    assert "Join" not in index._fresh()._jdf.queryExecution().optimizedPlan().toString()


def test_near_words_meet_in_pairs_that_count(spark, monkeypatch):
    rng = random.Random(5)
    words = sorted({"aaa" + "".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(90)} | {"abcd", "abce", "abcde", "xbcd", "naïve"})
    monkeypatch.setattr(queries, "dictionary_of", lambda s, d: s.createDataFrame([(w, w if w.isascii() else "naive") for w in words], "word string, k1 string"))

    def near(a, b):  # at a distance of one
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    some = [w for w in words if w.isascii()]
    want = [(a, b) for a in some for b in some if a < b and a[:3] == b[:3] and near(a, b)]
    found = queries.fuzzy_levenshtein_block(spark, "")
    assert sorted(map(tuple, found.collect())) == want
    assert "levenshtein" not in found._jdf.queryExecution().optimizedPlan().toString()  # no pair is met to be thrown away
