import math
import random

import numpy as np
import pytest

from quernstone.llm import op7_topk as op


def brute(rows, every, k):
    q = [(i, v, [math.floor(256 * x) for x in e]) for i, (v, e) in enumerate(rows) if v is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, v, a in q:
        if v % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), w) for j, w, b in q if j != i)[:k]
            out += [(v, r, w, -s) for r, (s, w) in enumerate(found, 1)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("d", [1, 3, 16, 64])
def test_against_brute_force(spark, monkeypatch, d):
    rng = random.Random(d)
    centres = [[rng.gauss(0, 0.2) for _ in range(d)] for _ in range(6)]
    rows = [(i, [c + rng.gauss(0, rng.choice([0, 0.05])) for c in rng.choice(centres)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(op, "BLOCK", 170)
    monkeypatch.setattr(op, "TILE", 40)
    monkeypatch.setattr(op, "AT_ONCE", 3)
    assert got(op.top_k(df, 20, 5)) == brute(rows, 20, 5)


@pytest.mark.parametrize("block,centroids", [(10**6, 1), (60, 7), (9, 40)])
def test_many_blocks_repeated_ids_and_ties(spark, monkeypatch, block, centroids):
    rng = random.Random(block)
    centres = [[rng.gauss(0, 0.2) for _ in range(12)] for _ in range(5)]
    rows = [(rng.randrange(300), [round(c + rng.gauss(0, 0.01), 2) for c in centres[min(4, rng.randrange(9))]]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cell", "2 as block")
    monkeypatch.setattr(op, "BLOCK", block)
    monkeypatch.setattr(op, "CENTROIDS", centroids)
    monkeypatch.setattr(op, "TILE", 16)
    monkeypatch.setattr(op, "ROWS_EACH", 1)
    assert got(op.top_k(df, 10, 5)) == brute(rows, 10, 5)


def test_bounds_leave_few_pairs_of_clustered_data(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.125, (40, 64))[rng.integers(0, 40, 20_000)] + rng.normal(0, 0.02, (20_000, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    tally = spark.sparkContext.accumulator(0)
    found = got(op.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 500, 5, tally))
    f = np.floor(256 * x)
    scores = f[::500] @ f.T
    scores[np.arange(40), np.arange(0, 20_000, 500)] = -np.inf
    want = [(500 * i, r, int(j), int(scores[i, j])) for i in range(40) for r, j in enumerate(np.lexsort((np.arange(20_000), -scores[i]))[:5], 1)]
    assert found == want
    assert tally.value < 0.2 * 40 * 20_000


def test_a_score_beyond_long_is_an_error(spark):
    df = spark.createDataFrame([(i, [1e9, 1e9]) for i in (50, 100, 3)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="larger than a long"):
        op.top_k(df).collect()


def test_envelopes_admit_every_vector():
    rng = np.random.default_rng(2)
    for d in (1, 5, 37, 64):
        x, c, q = (rng.integers(-300, 300, (n, d)).astype(float) for n in (50, 1, 80))
        bound = op.admits(q, c, op.envelope(x, c[0])[None])
        assert (bound[:, 0] >= (q @ x.T).max(1)).all()


def test_hard_cases(spark):
    rows = [(0, [1.0, -2.0]), (50, None), (100, [None, 1.0]), (150, [float("nan"), 1.0]), (200, [float("inf"), 1.0]), (3, [1.0, -2.0]), (2, [1.0, -2.0]), (None, [9.0, 9.0]), (250, []), (5, [1.0, 0.5, 7.0]), (4, [1e9, -1e9]), (300, [1e9, 1e9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(op.top_k(df.selectExpr("*", "1 as rank", "2 as score"))) == brute(rows, 50, 5)
    assert op.top_k(df.limit(0)).count() == 0
    assert op.top_k(df.where("vec_id = 0")).count() == 0
    same = [(i, [0.5, 0.5]) for i in range(120)]
    assert got(op.top_k(spark.createDataFrame(same, df.schema))) == brute(same, 50, 5)


def test_bounds_never_fall_short():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (200, 37)).astype(float)
    for s in (1, 4, 16, 37, 64):
        f = op.features(x, s)
        assert (f @ f.T >= x @ x.T - 1e-6).all()
