import json

import pytest
from pyspark.sql import functions as F

from quernstone.operators import maintain, monitor, sharding, spell, synonyms
from quernstone.operators import index as ix
from quernstone.plans.parse import Phrase
from quernstone.sources import files
from quernstone.streaming import index_stream

DOC = "id long, space string, doc_id string, updated long, title string, txt string, alive boolean"


@pytest.fixture(scope="module")
def index(spark):
    text = " ".join(["bicycle"] * 9 + ["motorcycle"] * 6 + ["the"] * 30 + ["rare"])
    return ix.Index.of(spark.createDataFrame([(1, "s", "1", 1, "title words", text, True)], DOC))


def test_dictionary_and_correction(index):
    words = spell.dictionary(index.vocabulary())
    assert {r["word"]: r["rank"] for r in words.collect()} == {"bicycle": 9, "motorcycle": 6}
    fixed, distance, changed = spell.corrected(index, words, [Phrase("bicicle"), Phrase("two words"), Phrase("bicycle"), Phrase("zzz")], {"zzz"})
    assert [p.text for p in fixed] == ["bicycle", "two words", "bicycle", "zzz"] and changed and distance > 0
    assert spell.corrected(index, words, [Phrase("bicycle")]) == ([Phrase("bicycle")], 0, False)
    near = spell.similar(words, ["bicykle"], most_distance=200).collect()
    assert near[0]["word"] == "bicycle" and near[0]["place"] == 1
    assert spell.lag(index.vocabulary(), words).first()["lag"] == 0


def test_stopwords(spark, index):
    assert [r["word"] for r in ix.stopwords(index.vocabulary(), 0.2).collect()] == ["the"]
    user = spark.createDataFrame([("the",)], "word string")
    assert ix.stopwords(index.vocabulary(), 0.2, user=user).count() == 0


def test_synonyms(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text('["a \\"group\\"", ["One", "two"]]\n\n["b", ["three"]]\n')
    rows = synonyms.read(spark, str(path))
    assert sorted(r["word"] for r in rows.collect()) == ["one", "three", "two"]
    assert sorted(json.loads(r["line"]) for r in synonyms.dump(rows).collect()) == [['a "group"', ["one", "two"]], ["b", ["three"]]]
    assert synonyms.lookup(rows, ["one", "none"]) == {"one": ("two",)}
    with pytest.raises(ValueError):
        synonyms.numbered(spark.createDataFrame([("x", ["a"]), ("y", ["a"])], "description string, words array<string>"))
    assert synonyms.replaced(rows, str(tmp_path / "kept")).count() == 3


def test_shards(spark):
    assert sharding.parse_group("2/5") == (1, 5)
    for bad in ("0/3", "4/3", "x", "1"):
        with pytest.raises(ValueError):
            sharding.parse_group(bad)
    docs = spark.createDataFrame([(str(i),) for i in range(50)], "doc_id string")
    assert sum(sharding.only(docs, i, 3).count() for i in range(3)) == 50
    assert sharding.needs_clone(79, 100) and not sharding.needs_clone(81, 100)
    workers = spark.createDataFrame([(0,), (2,)], "shard int")
    assert sorted(r[0] for r in sharding.missing(workers, 4).collect()) == [1, 3]


def test_latest_upsert_and_keys(spark):
    u = spark.createDataFrame([("s", "1", 1, "a", "x", True), ("s", "1", 3, "b", "y", False), ("s", "1", 2, "c", "z", True), ("s", "2", 9, "d", "w", True)], "space string, doc_id string, n long, title string, txt string, alive boolean")
    rows = {r["doc_id"]: r for r in maintain.latest(u, "n").collect()}
    assert rows["1"]["title"] == "" and not rows["1"]["alive"] and rows["2"]["txt"] == "w"
    base = spark.createDataFrame([("s", "1", "old"), ("s", "3", "kept")], "space string, doc_id string, title string")
    new = spark.createDataFrame([("s", "1", "new")], base.schema)
    assert sorted(r["title"] for r in maintain.upsert(base, new).collect()) == ["kept", "new"]
    maintain.unique_keys(base)
    with pytest.raises(ValueError):
        maintain.unique_keys(base.union(base))
    with pytest.raises(ValueError):
        maintain.unique_keys(base.withColumn("title", F.lit(None).cast("string")))


def test_pages_by_key(spark):
    docs = spark.createDataFrame([(t, i) for t in (1, 2) for i in "abc"], "updated long, doc_id string")
    seen, at = [], None
    while rows := maintain.keyset_page(docs, at, 2).collect():
        seen += [tuple(r) for r in rows]
        at = seen[-1]
    assert seen == [(t, i) for t in (1, 2) for i in "abc"]


def test_interest_list(spark):
    empty = spark.createDataFrame([], "space string, doc_id string, updated long, state int, requested_at double")
    refs = spark.createDataFrame([(str(i), i) for i in range(60)], "doc_id string, updated long")
    current = maintain.new_list(empty, refs, "s")
    assert maintain.states(current).first()["pending"] == 60
    asked = maintain.to_request(current, "s")
    assert asked.count() == 50 and asked.first()["doc_id"] == "0"
    with pytest.raises(ValueError):
        maintain.new_list(current, refs, "s")
    served = maintain.serve(current, current.select("space", "doc_id"))
    assert maintain.states(served).first()["served"] == 60
    assert maintain.new_list(served, refs.limit(1), "s").count() == 1
    docs = refs.select(F.lit("s").alias("space"), "doc_id", "updated")
    assert tuple(maintain.cursor(docs, served, 40).first()) == ("s", 40, "40")
    requested = current.withColumns({"state": F.lit(1), "requested_at": F.lit(5.0)})
    assert maintain.states(maintain.timed_out(requested, 9.0, 0.0)).first()["pending"] == 60
    assert maintain.states(maintain.timed_out(requested, 40.0, 0.0)).first()["served"] == 60
    wanted, present = maintain.split_wanted(docs, docs.where("updated < 10"))
    assert wanted.count() == 50 and present.count() == 10
    assert maintain.not_future(docs, -maintain.FUTURE_NS + 3).count() == 4


def test_cache():
    now = [0.0]
    c = maintain.ResultCache(most_bytes=400, max_age_s=10, clock=lambda: now[0])
    c.put(("q",), [{"id": "1"}])
    assert c.get(("q",)) == [{"id": "1"}]
    c.forget({"1"})
    assert c.get(("q",)) is None and c.size == 0
    c.put(("q",), [{"id": "1"}])
    now[0] = 11
    assert c.get(("q",)) is None
    for i in range(20):
        c.put((i,), [{"id": str(i)}])
    assert c.size <= 400 and c.get((0,)) is None and c.get((19,))


def test_monitoring(spark):
    r = spark.createDataFrame([(float(i), "ok" if i % 4 else "bad") for i in range(1, 11)], "seconds double, status string")
    row = monitor.load_report(r).first()
    assert (row["n"], row["mean"], row["median"], row["p90"], row["p99"], row["success"]) == (10, 5.5, 6.0, 10.0, 10.0, 0.8)
    w = spark.createDataFrame([("a", 0, "1.0", False), ("b", 1, "1.5", False), ("c", 1, "2.0", True)], "worker string, shard int, version string, stale boolean")
    status = lambda *a, **k: monitor.group_status(*a, **k).first()["status"]
    assert status(w, 2, "1.1") == monitor.IN_SYNC and status(w, 2, "1.1", pending=3) == monitor.SYNCING
    assert status(w, 3, "1.1") == monitor.INCOMPLETE and status(w, 2, "2.0") == monitor.INCOMPATIBLE and status(w, 2, "1.1", started=False) == monitor.STARTING
    d = spark.createDataFrame([("ab", "cd")], "title string, txt string")
    assert tuple(monitor.loaded(d, 2.0).first()) == (4, 2e-6)


def test_files(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text('{"id":"x","title":"T","text":"b","date":"2020-01-01T00:00:00Z"}\n{"title":"U","date":"1950-01-01T00:00:00Z"}\n')
    rows = files.read_documents(spark, str(path), "wp").collect()
    assert rows[0]["updated"] == 1577836800 * 10**9 and rows[1]["updated"] == 0 and rows[1]["txt"] == ""
    assert sorted(r["doc_id"] for r in files.read_documents(spark, str(path), "wp", auto_ids=True).collect()) == ["0", "1"]
    assert {r["updated"] for r in files.served_documents(spark, str(path), 7).collect()} == {1577836800 * 10**9, -631152000 * 10**9}
    docs = files.read_documents(spark, str(path), "wp")
    kept = files.write_documents(docs, str(tmp_path / "out"), packed=True)
    assert sorted(r["txt"] for r in files.read_packed(kept).collect()) == ["", "b"]
    files.compact(spark, str(tmp_path / "out"), str(tmp_path / "small"), 1)
    assert spark.read.parquet(str(tmp_path / "small")).count() == 2
    load = tmp_path / "l.json"
    load.write_text('{"Iterations": 3,\n "Spaces": ["wp"], "Queries": ["a b"], "Limit": 5}')
    assert files.read_load_set(spark, str(load)).first()["Queries"] == ["a b"]
    files.write_results(spark.createDataFrame([(1.0, 2.0, "ok")], "seconds double, duration double, status string"), str(tmp_path / "csv"))
    assert [r["value"] for r in files.json_values(spark, '["a","b"]').collect()] == ["a", "b"]


def test_streams(spark, tmp_path):
    schema = "space string, doc_id string, n long, updated long, title string, txt string, alive boolean"
    spark.createDataFrame([("s", "1", 1, 1, "a", "x", True), ("s", "2", 2, 1, "b", "y", True), ("s", "3", 3, 10**18, "f", "f", True)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    to = index_stream.DocumentTable(spark, str(tmp_path / "t"))
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    index_stream.follow(read(), to, "n", now=0).awaitTermination()
    assert sorted(r["title"] for r in to.read().collect()) == ["a", "b"]
    spark.createDataFrame([("s", "1", 4, 2, "c", "z", False)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    index_stream.follow(read(), to, "n", now=0).awaitTermination()  # goes on from its checkpoint
    rows = {r["doc_id"]: r for r in to.read().collect()}
    assert not rows["1"]["alive"] and rows["1"]["title"] == "" and rows["2"]["title"] == "b"
    assert to.compact(9).read().count() == 2
