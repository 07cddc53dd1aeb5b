"""Blocks of postings, as a saved index has them."""

import random

from quernstone.operators.index import Analyser, Index

SCHEMA = "id long, space string, doc_id string, updated long, title string, txt string, alive boolean"


def test_blocks_hold_every_occurrence(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(30)] + ["bikes", "bike", "vélo", "velo"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i * 2**40, rng.choice(["a", "b"]), str(i), i, text(rng.randrange(4)), text(rng.choice([0, 1, 50])), rng.random() < 0.8) for i in range(60)]
    for n, analyser in enumerate((Analyser(), Analyser(("english",), True))):
        made = Index.of(spark.createDataFrame(rows, SCHEMA), analyser)
        saved = made.save(f"file://{tmp_path}/{n}", 3)
        columns = ["id", "col", "off", "term", "n_tokens", "space", "alive"]
        want = sorted(map(tuple, made.postings.select(*columns).collect()))
        assert sorted(map(tuple, saved.postings.select(*columns).collect())) == want
        again = Index(saved.docs, saved.postings, saved.texts, analyser).save(f"file://{tmp_path}/again{n}", 3)  # without tokens, as a merge of segments
        assert sorted(map(tuple, again.postings.select(*columns).collect())) == want
        for other in (saved, again):
            assert sorted(map(tuple, other.vocabulary().collect())) == sorted(map(tuple, made.vocabulary().collect()))
        assert spark.read.parquet(f"file://{tmp_path}/{n}/postings").count() < len(want) / 3
