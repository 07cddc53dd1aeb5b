import random
import re

import pytest

from quernstone.llm import op3_mix as op


def waterfill(sizes, weights, most=3.0):
    total, target, free = sum(sizes.values()), {}, dict(sizes)
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left = total
    while free:
        share = left / sum(w[s] for s in free)
        over = [s for s in free if share * w[s] > most * sizes[s]]
        if not over:
            return target | {s: share * w[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            del free[s]
    return target


@pytest.mark.parametrize("bucket_rows", [100_000, 40, 3])
def test_targets_and_takings(docs_of, monkeypatch, bucket_rows):
    monkeypatch.setattr(op, "BUCKET_ROWS", bucket_rows)
    monkeypatch.setattr(op, "FAN", 2)
    rng = random.Random(3)
    rows = [(i, "w " * rng.choice([0, 1, 5, 20]), rng.choice(["a", "a", "a", "b", "é", "z", None])) for i in range(400)] + [(1000, "w " * 3, "tiny")]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + t.count("w")
    want = waterfill(sizes, op.WEIGHTS)
    got = op.mix(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    taken = dict.fromkeys(sizes, 0)
    for i, t, s in rows:
        r = by_id[i]
        n = t.count("w")
        assert r["size"] == n and r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6
        assert 0 <= r["taken"] <= 3 * n and (n == 0 or r["taken"] % n == 0)
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 20
    again = {r["doc_id"]: r["taken"] for r in op.mix(docs_of(rows[::-1]).repartition(5)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}


def test_expectation_is_kept():
    # one document of two is taken: each half of the time
    ups = 0
    import pyarrow as pa

    for h in range(2000):
        rows = pa.RecordBatch.from_arrays([pa.array([0, 0]), pa.array(["s", "s"]), pa.array([1, 2]), pa.array([None, None], pa.int64()), pa.array([4, 4]), pa.array([h * 7919, h * 104729 + 1]), pa.array([0, 0]), pa.array([0.25, 0.75])], op._NAMES[:8])
        out = [r for b in op._pivot(True, iter([rows])) for r in b.to_pylist()]
        assert sum(r["copies"] for r in out) == 1
        ups += next(r["copies"] for r in out if r["doc_id"] == 1)
    assert abs(ups / 2000 - 0.25) < 0.05


def test_hard_cases(docs_of, hard):
    got = op.mix(hard).collect()
    assert len(got) == hard.count()
    sizes = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in hard.collect()}
    assert all(r["size"] == sizes[r["doc_id"]] and r["taken"] <= 3 * r["size"] for r in got)
    assert op.mix(hard.limit(0)).count() == 0
    assert op.mix(docs_of([(1, None), (2, " ")])).count() == 2


def test_mixed_rows(docs_of):
    docs = docs_of([(i, "w " * (i % 9), "abc"[i % 3]) for i in range(120)])
    copies = {r["doc_id"]: r["copies"] for r in op.mix(docs).collect()}
    out = op.mixed(docs)
    assert out.columns == docs.columns
    got = [r["doc_id"] for r in out.collect()]
    assert {i: got.count(i) for i in copies if copies[i]} == {i: n for i, n in copies.items() if n}


def test_rows_without_id_are_documents_of_their_own(docs_of):
    rows = [(None, "w " * (1 + i % 7), "a") for i in range(300)] + [(None, "w w", "b")] * 200 + [(i, "w " * 9, "b") for i in range(30)] + [(None, None, None)] * 5
    docs = docs_of(rows)
    want = waterfill({s: sum((t or "").count("w") for _, t, x in rows if x == s) for s in ("a", "b", None)}, op.WEIGHTS)
    got = op.mix(docs).collect()
    assert len(got) == len(rows)
    for size, target in {(r["source_size"], r["target"]) for r in got}:
        if size:
            own = [r for r in got if r["source_size"] == size]
            assert abs(sum(r["taken"] for r in own) - target) <= 9 and abs(target - min(want.values(), key=lambda x: abs(x - target))) < 1e-6
    assert len({r["copies"] for r in got if r["doc_id"] is None and r["size"] == 2}) > 1  # equal rows are drawn one by one
    out = op.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in got)
