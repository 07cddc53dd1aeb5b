import base64
import glob
import gzip
import hashlib
import json
import os
import random

import duckdb
import pytest

from quernstone.llm import op9_warc as op

SCHEMA = "page_id long, url string, html string"


def brute(rows, at_least=0):
    keep = {}
    for p, _, h in rows:
        if len((h or "").encode()) >= at_least:
            keep.setdefault(h or "", []).append(p)
    out = []
    for p, _, h in rows:
        h = h or ""
        ids = keep.get(h, [])
        top = max((i for i in ids if i is not None), default=None)
        revisit = len(ids) > 1 and top is not None and p != top
        out.append((p, len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    made = [(i, f"http://{rng.choice('abc')}.Example.org:80/{rng.randrange(5)}?x={i % 3}", rng.choice(["", None, f"<p>é{i % 40}</p>", "z" * rng.randrange(3000), "hot page"])) for i in range(300)]
    return made + [(None, None, "hot page"), (299, "bad url \r\nX: y", "hot page"), (500, "http://[::1", "WARC/1.1\r\n\r\n"), (501, "x", "y" * 400_000), (None, "u", "alone")]


@pytest.mark.parametrize("at_least", [0, 8, 10**6])
def test_round_trip(spark, rows, at_least):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as file", "2 as digest")
    assert sorted((tuple(r)[:5] for r in op.round_trip(df, at_least).collect()), key=repr) == brute(rows, at_least)


def test_shuffled_resolution(spark, rows, monkeypatch):
    monkeypatch.setattr(op, "may_broadcast", lambda df, *_: df)
    assert sorted((tuple(r)[:5] for r in op.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert op.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("fan,range_rows", [(64, 10**6), (3, 20), (2, 7)])
def test_archives_runs_and_histories(spark, rows, tmp_path, monkeypatch, fan, range_rows):
    monkeypatch.setattr(op, "SAMPLE", 5)  # in the driver only: the workers sample as they do
    hot = [(1000 + i if i % 3 else None, "http://hot.example.org/", f"hot {i}") for i in range(150)] + [(1001, "http://hot.example.org/", "again")] * 3
    df = spark.createDataFrame(rows + hot, SCHEMA).repartition(7)
    archives = op.write(df, f"file://{tmp_path}", roll=30_000)
    files = glob.glob(f"{tmp_path}/*.warc.gz")
    assert len(files) >= 7 and {r["file"] for r in archives.collect()} == {os.path.basename(f) for f in files}
    whole = b"".join(gzip.open(f).read() for f in files)
    assert whole.count(b"WARC/1.1\r\nWARC-Type: ") == len(rows) + len(hot) == sum(r["records"] for r in archives.collect())
    got = op.histories(archives, f"file://{tmp_path}", fan, range_rows).collect()
    names = [c.split()[0] for c in op._CAPTURE.split(", ")]
    order = [op._order(tuple(r[c] for c in names)) for r in sorted(got, key=lambda r: r["span"])]
    assert order == sorted(order) and len(order) == len(rows) + len(hot)
    seen = {}
    for r in sorted(got, key=lambda r: op._order(tuple(r[c] for c in names))):
        assert r["history_pos"] == seen.get(r["url_key"], 0)
        seen[r["url_key"]] = r["history_pos"] + 1
    for r in got[::40]:  # each capture is found by its place
        with open(f"{tmp_path}/{r['file']}", "rb") as f:
            f.seek(r["position"])
            _, _, content = next(op.members(f))
        headers, _ = op.parse(content)
        assert op._id(headers["warc-record-id"]) == r["page_id"]


def test_merging_runs_by_ranges(tmp_path, monkeypatch):
    monkeypatch.setattr(op, "GROUP_ROWS", 4)
    monkeypatch.setattr(op, "SAMPLE", 3)
    rng = random.Random(13)
    rows = [(rng.choice(["a", "b", "hot", "hot", "hot", "z"]), rng.choice(["1", "2"]), rng.choice([None, 1, 2]), f"f{i % 5}", i, 0, "D", "response", None) for i in range(200)]
    names, keys = [], []
    for f in range(5):
        run = op._Run(str(tmp_path))
        for r in sorted((r for r in rows if r[3] == f"f{f}"), key=op._order):
            run.add(r)
        name, n, samples = run.close()
        assert n == 40
        names.append(name)
        keys += map(tuple, json.loads(samples))
    want = sorted(rows, key=op._order)
    assert list(op.merge_runs(str(tmp_path), names)) == want
    edges = [None, *sorted(rng.sample(keys, 9)), None]
    assert [r for a, b in zip(edges, edges[1:]) for r in op.merge_runs(str(tmp_path), names, a, b)] == want


def test_query_with_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.exists(folder):
        pytest.skip("no test data")
    db = duckdb.connect()
    db.execute(f"create view pages as select * from '{folder}/pages.parquet'")
    want = db.sql(op.SQL)
    out = op.query(spark, folder)
    assert sorted(out.columns) == sorted(want.columns)
    assert sorted(map(tuple, out.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_loser_tree():
    rng = random.Random(12)
    for k in range(9):
        runs = [sorted(rng.randrange(20) for _ in range(rng.randrange(6))) for _ in range(k)]
        assert list(op.LoserTree([iter(r) for r in runs], lambda x: (x,))) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert op.url_key("http://www.Example.org:80/a/B?q=1") == "org,example,www)/a/B?q=1"
    assert op.url_key("https://x.org:8443") == "org,x:8443)/" and op.url_key("no url") == "no url"


def test_broken_archives_are_noticed(tmp_path):
    path = tmp_path / "x.warc.gz"
    path.write_bytes(gzip.compress(op.record(1, "u", b"abc", "D", None))[:-9])
    with open(path, "rb") as f, pytest.raises(ValueError):
        list(op.members(f))
