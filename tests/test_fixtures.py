"""Measured values of public components: nearness, ranks, tokens, vocabulary, shard hashes."""

import pytest
from pyspark.sql import functions as F

from quernstone.functions import text
from quernstone.operators import maintain, sharding
from quernstone.operators.index import Index
from quernstone.plans import search as plan
from quernstone.plans.parse import Phrase, parse

SCHEMA = "id long, space string, doc_id string, updated long, title string, txt string, alive boolean"


def index(spark, rows):
    return Index.of(spark.createDataFrame([(i, "s", str(i), i, t, x, True) for i, (t, x) in enumerate(rows, 1)], SCHEMA))


def found(ix, phrases):
    phrases = parse(phrases) if isinstance(phrases, str) else phrases
    wanted = plan.parts(ix, phrases)
    return {r["id"]: r["rank"] for r in plan.matches(ix, wanted).collect()} if plan.status_of(wanted) == plan.OK else {}


def gap(n):
    return " ".join(f"w{i}" for i in range(n))


def test_nearness(spark):
    rows = [("", f"aa {gap(n)} bb") for n in (14, 15, 16)] + [("", f"bb {gap(n)} aa") for n in (14, 15, 16)]
    rows += [("aa", "bb"), ("cc", "aa bb"), ("", f"aa {gap(7)} bb {gap(7)} dd"), ("", f"aa {gap(7)} bb {gap(8)} dd")]
    ix = index(spark, rows)
    assert set(found(ix, "aa bb")) == {1, 2, 4, 5, 8, 9, 10}
    assert set(found(ix, "aa bb -cc")) == {1, 2, 4, 5, 9, 10}
    assert set(found(ix, "aa bb dd")) == {9}
    assert set(found(ix, [Phrase("aa"), Phrase("!!"), Phrase("bb")])) == set(found(ix, "aa bb"))
    assert found(ix, [Phrase("!!")]) == {} and found(ix, "-aa") == {}


def test_instances_that_are_not_near_do_not_count(spark):
    ix = index(spark, [("", f"aa bb {gap(30)} aa"), ("", "zz"), ("", "yy"), ("", "xx qq"), ("", "pp"), ("", "aa")])
    assert found(ix, "aa bb") == pytest.approx({1: -0.7073419654302}, abs=1e-12)


def test_rank_at_the_floor(spark):
    rows = [("red apple", "apple pie is good apple"), ("", "banana split and apple core"), ("banana", "nothing here at all"), ("", ""), ("zebra", f"apple {gap(20)} banana")]
    got = found(index(spark, rows), "apple")
    assert got[1] * 1e6 == pytest.approx(-1.9041, abs=1e-4) and set(got) == {1, 2, 5}


def test_tokens():
    t = "Rökare_x co-op 3.14 don't ½ straße a_b"
    assert [text.fold(x) for x, _, _ in text.spans(t, least_bytes=1)] == ["rokare", "x", "co", "op", "3", "14", "don", "t", "½", "straße", "a", "b"]


def test_vocabulary(spark):
    ix = index(spark, [("", "aa aa bb"), ("", "aa")])
    assert {tuple(r) for r in ix.vocabulary().select("term", "doc", "cnt").collect()} == {("aa", 2, 3), ("bb", 1, 1)}


def test_shards(spark):
    docs = spark.range(1076).select(F.col("id").cast("string").alias("doc_id"))
    assert spark.range(1).select(text.fnv1a(F.lit("a")), text.shard_of(F.lit("0"), 5)).first()[:] == (3826002220, 3)
    assert [r["n_docs"] for r in sharding.spread(docs, 5).orderBy("shard").collect()] == [219, 212, 212, 215, 218]


def test_work_list_and_cursor(spark):
    empty = spark.createDataFrame([], "space string, doc_id string, updated long, state int, requested_at double")
    refs = spark.createDataFrame([("bello", 7), ("koko", 9)], "doc_id string, updated long")
    docs = refs.select(F.lit("s").alias("space"), "doc_id", "updated")
    none = maintain.cursor(docs, empty, 99)
    assert none.count() == 0 and maintain.cursor_of(none, "s", ("s",)) == (0, "")
    current = maintain.new_list(empty, refs, "s", ("s",))
    assert {(r["doc_id"], r["state"] == maintain.SERVED) for r in current.collect()} == {("bello", False), ("koko", False)}
    assert maintain.cursor(docs, current, 99).count() == 0
    served = maintain.serve(current, docs.where("doc_id = 'koko'"))
    assert maintain.cursor_of(maintain.cursor(docs, served, 99), "s", ("s",)) == (9, "koko")
    for call in (lambda: maintain.new_list(empty, refs, "x", ("s",)), lambda: maintain.cursor_of(none, "x", ("s",)), lambda: maintain.new_list(served, refs, "s", ("s",))):
        with pytest.raises(ValueError):
            call()
