import random
import zlib

import numpy as np

from quernstone.llm import op1_toxicity as op

BAD = ["idiot", "moron", "scumbag", "loathsome"]


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ta", "re", "ni", "lo", "su", "ke", "mi"]) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.choice([5, 40, 400]))]
        y = int(rng.random() < 0.3)
        if y:
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = rng.choice(BAD)
        rows.append((i, " ".join(words), y))
    return rows


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_learns_on_held_out_rows_and_misspellings():
    rows = corpus(900, 1)
    model = op.train([t for i, t, _ in rows if not held(i)], [y for i, _, y in rows if not held(i)])
    test = [(t, y) for i, t, y in rows if held(i)]
    s, y = model.scores([t for t, _ in test]), np.array([y for _, y in test])
    assert ((s >= op.THRESHOLD) == y).mean() > 0.97
    low, high = model.scores(["tare niloo suke mita", "tare niloo suke idiott mita"])
    assert high > 0.3 > low
    assert model.scores([""]).tolist() == [0.0]


def test_scores_by_brute_force():
    """Each score from embeddings, softmax and words, one by one."""
    rng = np.random.default_rng(3)
    emb, soft, bias = rng.normal(size=(1 << op.BITS, 4)), rng.normal(size=(2, 4)), rng.normal(size=2)
    model = op.Model(emb @ (soft[1] - soft[0]), float(bias[1] - bias[0]))
    texts = [t for _, t, _ in corpus(40, 5)] + ["one", "Two, words!", "bad bad bad fine", "é ☃ ... <>", ""]
    for text, got in zip(texts, model.scores(texts)):
        odds = []
        for w in text.lower().split():
            ids, _ = op.grams([w.strip(op._edge) or w])
            odds.append((soft @ emb[ids].mean(0)).tolist())
        odds.sort(key=lambda z: z[0] - z[1])
        worst = np.array(odds[: op.WORST])
        want = 0.0 if not len(worst) else np.exp(worst.mean(0) + bias)[1] / np.exp(worst.mean(0) + bias).sum()
        assert abs(got - want) < 1e-9


def test_gradients_against_differences():
    rng = np.random.default_rng(4)
    emb, soft, bias = rng.normal(size=(9, 3)), rng.normal(size=(2, 3)), rng.normal(size=2)
    flat, whose, y = rng.integers(0, 7, 20), np.sort(rng.integers(0, 4, 20)), np.array([1, 0, 0, 1])
    share = 1 / np.bincount(whose, minlength=4)[whose]
    _, d_soft, d_bias, where, d_emb = op.gradients(emb, soft, bias, flat, share, whose, y)
    full = np.zeros_like(emb)
    full[where] = d_emb
    for param, grad in ((emb, full), (soft, d_soft), (bias, d_bias)):
        for i in np.ndindex(param.shape):
            was, step, losses = param[i], 1e-6, []
            for sign in (1, -1):
                param[i] = was + sign * step
                losses.append(op.gradients(emb, soft, bias, flat, share, whose, y)[0])
            param[i] = was
            assert abs((losses[0] - losses[1]) / (2 * step) - grad[i]) < 1e-6


def test_one_clean_word_that_looks_bad_is_not_enough():
    model = op.Model(np.zeros(1 << op.BITS), 0.0)
    model.memo = {"bad": 9.0, "fine": -6.0}
    scores = model.scores(["fine bad fine", "bad fine bad fine", "bad", "bad " * 50_000, "fine " * 50_000 + "bad bad bad"])
    assert (scores >= op.THRESHOLD).tolist() == [False, True, True, True, True]


def test_repeated_ids_and_long_texts_are_learned(spark, docs_of):
    rows = corpus(200, 6)
    long = [(i, t + " tare" * 40_000, y) for i, t, y in rows[:20]]
    docs = docs_of([(i, t) for i, t, _ in long + rows[20:] + rows[20:]] + [(7, "zz another text of the same id")])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    once = docs_of([(i, t) for i, t, _ in long + rows[20:]])
    assert np.allclose(op.fit(docs, labels).value, op.fit(once, labels).value)
    small = op.fit(docs, labels, rows=20)
    assert small.value is not None


def test_fit_score_query_columns(spark, docs_of, hard):
    rows = corpus(300, 2)
    docs = docs_of([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = op.fit(docs, labels)
    again = op.fit(docs.repartition(3), labels)
    got = {r["doc_id"]: r["score"] for r in op.score(docs, model).collect()}
    assert got == {r["doc_id"]: r["score"] for r in op.score(docs, again).collect()}
    # labels of held-out rows change nothing
    flipped = spark.createDataFrame([(i, 1, 1 - y if held(i) else y) for i, _, y in rows], labels.schema)
    assert got == {r["doc_id"]: r["score"] for r in op.score(docs, op.fit(docs, flipped)).collect()}
    out = op.score(hard, model).collect()
    assert len(out) == hard.count() and all(0 <= r["score"] <= 1 for r in out)
    kept = op.clean(hard, model)
    assert kept.schema == hard.schema and kept.where("doc_id = 1").count() == 1
    assert op.clean(hard.limit(0), model).count() == 0


def test_labels_of_one_class_or_none(spark, docs_of, hard):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in op.score(hard, op.fit(hard, none)).collect()} == {0.0}
    ones = spark.createDataFrame([(4, 1, 1), (5, 1, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")
    assert len({r["score"] for r in op.score(hard, op.fit(hard, ones)).collect()}) == 1


def test_grams_cover_every_word():
    ids, starts = op.grams(["", "a", "ab", "abcdef"])
    assert np.diff(np.append(starts, len(ids))).tolist() == [1, 1, 3, sum(8 - n + 1 for n in op.GRAMS)]
