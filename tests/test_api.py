import json

import pytest
from pyspark.sql import functions as F

from quernstone import __main__ as cli
from quernstone.api import DocumentManager, SearchAgent
from quernstone.config import Config
from quernstone.operators import spell, synonyms
from quernstone.plans import search as plan
from quernstone.streaming import interest_stream as interest
from quernstone.streaming.index_stream import to_table

SCHEMA = "space string, doc_id string, updated long, title string, txt string, alive boolean"


def test_config():
    assert Config().shard_size == 1 and Config(shard="2/3").shard_index == 1
    for bad in ({"shard": "4/3"}, {"spaces": ()}, {"spaces": ("a", "a")}, {"stopword_cutoff": 101}, {"expire_seconds": 1}, {"result_cap": 0}, {"snippet": "x"}):
        with pytest.raises(ValueError):
            Config(**bad)
    c = Config.from_env({"QUERNSTONE_SPACES": "a, b", "QUERNSTONE_REMOVE_DIACRITICS": "no", "QUERNSTONE_RESULT_CAP": "7"})
    assert c.spaces == ("a", "b") and not c.remove_diacritics and c.result_cap == 7


@pytest.fixture(scope="module")
def manager(spark, tmp_path_factory):
    m = DocumentManager(spark, f"file://{tmp_path_factory.mktemp('m')}", Config(spaces=("en",), stopword_cutoff=60))
    m.add(spark.createDataFrame([("en", "1", 1, "Old", "bicycle " * 6, True), ("en", "2", 1, "Cars", "driving cars", True), ("xx", "9", 1, "no", "bicycle", True)], SCHEMA))
    m.add(spark.createDataFrame([("en", "1", 2, "Bikes", "riding bicycles " * 6, True), ("en", "3", 2, "Gone", "bicycle", False)], SCHEMA))
    return m


def test_documents_in_answers_out(spark, manager):
    index = manager.index()
    groups = synonyms.numbered(spark.createDataFrame([("g", ["auto", "cars"])], "description string, words array<string>"))
    agent = SearchAgent(index, manager.config, spell.dictionary(index.vocabulary()), groups)
    found = agent.search("bicycle ride")
    assert [h["id"] for h in found.hits] == ["1"] and found.total == 1 and found.status == plan.OK and not found.cached
    again = agent.search("RIDE bicycle")
    assert again.cached and again.hits == found.hits
    agent.forget({"1"})
    assert not agent.search("bicycle ride").cached
    assert [h["id"] for h in agent.search("auto").hits] == ["2"]
    lost = agent.search("bicicl")
    assert lost.status == plan.NO_HIT and lost.respelt == "bicycl" and lost.respelt_distance > 0
    fixed = agent.search("bicicl", autocorrect=True)
    assert [h["id"] for h in fixed.hits] == ["1"] and fixed.respelt == "bicycl"
    assert agent.search("-cars").status == plan.QUERY_ERROR and agent.search("").status == plan.NO_HIT


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_spark", lambda: spark)
    monkeypatch.setenv("QUERNSTONE_STOPWORD_CUTOFF", "30")
    path = tmp_path / "d.json"
    path.write_text("\n".join(json.dumps({"id": str(i), "title": f"t{i}", "text": "red house" if i else "blue house"}) for i in range(3)))
    index = f"file://{tmp_path}/i"
    run = lambda *a: (cli.main(list(a)), capsys.readouterr().out)[1]
    run("load", index, "wp", str(path))
    assert "wp/0" in run("search", index, "blue") and "ok: 1 hits" in run("search", index, "blue")
    assert run("sql", index, "select count(*), max(doc_id) from docs").strip() == "3, 2"
    assert "n_docs" in run("stats", index)
    with pytest.raises(SystemExit) as e:
        cli.main(["check", index])
    assert not e.value.code
    run("rebuild", index, f"{index}-2")
    assert "wp/0" in run("search", f"{index}-2", "blue")
    run("spelling", index, "--least", "1")
    words = tmp_path / "s.json"
    words.write_text('["d", ["a", "b"]]\n')
    run("synonyms", index, str(words))
    assert run("synonyms", index).strip() == '["d",["a","b"]]'
    assert "hous" in run("stopwords", index) and "QUERNSTONE_SHARD=1/1" in run("env")


def test_interest_steps():
    s, why = interest.step(None, "wanted", 5, 0.0)
    assert s == (0, 5, 0.0, 0.0) and why == "wanted" and interest.step(None, "served", 5, 0.0) == (None, "")
    s, _ = interest.step(s, "requested", 5, 1.0)
    assert interest.expired(s, 3.9) == (s, "") and interest.expired(s, 4.0)[0][0] == 0 and interest.expired(s, 31.0)[0][0] == 2
    assert interest.step((2, 5, 0.0, 0.0), "wanted", 5, 9.0)[1] == "" and interest.step((2, 5, 0.0, 0.0), "wanted", 6, 9.0)[1] == "wanted"


def test_interest_stream(spark, tmp_path):
    rows = [("s", "a", "wanted", 1, 0, 0), ("s", "a", "requested", 1, 1, 1), ("s", "a", "served", 1, 2, 2), ("s", "b", "wanted", 1, 3, 0), ("s", "b", "requested", 1, 4, 1), ("s", "b", "requested", 1, 5, 6)]
    df = spark.createDataFrame(rows, "space string, doc_id string, event string, updated long, n long, t long").select("space", "doc_id", "event", "updated", "n", F.timestamp_seconds(F.col("t") + 1_000_000).alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = to_table(interest.transitions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), spark)
    by = {k: [r["reason"] for r in got.where(F.col("doc_id") == k).orderBy("at", "reason").collect()] for k in "ab"}
    assert by["a"] == ["wanted", "requested", "served"]
    assert by["b"][:2] == ["wanted", "requested"] and "asked too long ago" in by["b"]


def test_pulled_source_goes_on_from_its_cursor(spark, tmp_path):
    from quernstone.sources.cursor_source import CursorSource, pull

    docs = [("s" if i % 2 else "t", f"{i:02d}", i // 3) for i in range(20)]
    spark.createDataFrame(docs, "space string, doc_id string, updated long").write.parquet(str(tmp_path / "docs"))
    path = str(tmp_path / "docs")
    assert pull(path, None, (1, "04"), 2) == [("s", "05", 1), ("t", "06", 2)]
    assert [d for _, d, _ in pull(path, "s", (-1, ""), 99)] == [f"{i:02d}" for i in range(1, 20, 2)]
    spark.dataSource.register(CursorSource)
    stream = lambda: spark.readStream.format("quernstone_updates").option("path", path).option("limit", 7).load()

    def run(n):
        q = stream().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            while not q.exception() and (not (tmp_path / "out").exists() or spark.read.schema("space string, doc_id string, updated long").parquet(str(tmp_path / "out")).count() < n):
                q.processAllAvailable()
        finally:
            q.stop()

    run(20)
    spark.createDataFrame([("s", "99", 50)], "space string, doc_id string, updated long").write.mode("append").parquet(path)
    run(21)
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [*(f"{i:02d}" for i in range(20)), "99"]


def test_load_sets_and_latest_status(spark, manager, tmp_path):
    from quernstone.api import run_load
    from quernstone.operators.monitor import load_report
    from quernstone.sources.files import read_load_set
    from quernstone.streaming.index_stream import latest_stream

    path = tmp_path / "l.json"
    path.write_text('{"Iterations": 4, "Spaces": ["en"], "Queries": ["cars", "-cars"], "Limit": 5}')
    report = load_report(run_load(SearchAgent(manager.index(), manager.config), read_load_set(spark, str(path)), 3)).first()
    assert report["n"] == 4 and 0 < report["success"] < 1
    rows = spark.createDataFrame([("w", 1, 10), ("w", 2, 20), ("v", 3, 5)], "worker string, n long, t long").select("worker", "n", F.timestamp_seconds(F.col("t") + 1_000_000).alias("ts"))
    rows.write.parquet(str(tmp_path / "st"))
    got = to_table(latest_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "st")), "worker", "ts"), spark, "complete")
    assert {r["worker"]: r["n"] for r in got.collect()} == {"w": 2, "v": 3}
