"""An index grown by batches against one made of the final documents at once."""

import random

import pytest

from quernstone.operators import segments as sg
from quernstone.operators.index import Index
from quernstone.plans import search as plan

SCHEMA = "space string, doc_id string, updated long, title string, txt string, alive boolean"


def batches(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["ab", "cd", "ef", "gh", "ij", "kl"])
    out, known = [], 0
    for b in range(3):
        rows = [("s", str(known + i), b, word(), " ".join(word() for _ in range(rng.randrange(12))), True) for i in range(8)]
        rows += [("s", str(i), b, word(), " ".join(word() for _ in range(rng.randrange(12))), rng.random() < 0.7) for i in rng.sample(range(known), min(known, 5))]
        known += 8
        out.append(rows + rows[:1])
    return out


def same(got: Index, want: Index):
    assert sorted(map(tuple, got.vocabulary().select("term", "doc", "cnt").collect())) == sorted(map(tuple, want.vocabulary().select("term", "doc", "cnt").collect()))
    assert got.totals() == want.totals()
    for q in ('"ab cd"', "ab -gh"):
        a, b = ([tuple(r) for r in plan.search(i, q, limit=50).collect()] for i in (got, want))
        assert a == b, q
    assert got.check().count() == 0


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_batches_merge_and_sweep(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(sg, "BROADCAST_ROWS", broadcast)
    grown = sg.Segments(spark, f"file://{tmp_path}/i")
    with pytest.raises(ValueError):
        grown.open()
    last: dict[str, tuple] = {}
    for n, rows in enumerate(batches(1), 1):
        assert grown.add(spark.createDataFrame(rows, SCHEMA)) == n
        last |= {r[1]: r for r in rows}
    ids = {r["doc_id"]: r["id"] for r in grown.open().docs.collect()}
    assert len(ids) == len(last) == len(set(ids.values()))
    want = Index.of(spark.createDataFrame([(ids[r[1]], *r) for r in last.values()], "id long, " + SCHEMA))
    same(grown.open(), want)
    assert grown.current() == [(1, 1), (2, 2), (3, 3)]
    if not broadcast:
        return
    grown.merge()
    assert grown.current() == [(1, 3)]
    same(grown.open(), want)
    again = [("s", "0", 9, "new", "new text", True), ("s", "x", 9, "new", "more", True)]
    assert grown.add(spark.createDataFrame(again, SCHEMA)) == 4
    now = {r["doc_id"]: r["id"] for r in grown.open().docs.collect()}
    assert now.pop("x") > max(ids.values()) and now == ids
    grown.sweep()
    assert sorted(p.name for p in (tmp_path / "i").iterdir()) == ["seg-1-3", "seg-4-4"]
    assert sorted(r["id"] for r in plan.search(grown.open(), "new").collect()) == ["0", "x"]


def test_an_unfinished_segment_does_not_count(spark, tmp_path):
    grown = sg.Segments(spark, f"file://{tmp_path}/i")
    grown.add(spark.createDataFrame(batches(2)[0], SCHEMA))
    (tmp_path / "i" / "seg-2-2" / "postings").mkdir(parents=True)
    assert grown.batches == 1 and grown.current() == [(1, 1)]
    assert grown.add(spark.createDataFrame(batches(3)[0], SCHEMA)) == 2
    assert grown.current() == [(1, 1), (2, 2)]
