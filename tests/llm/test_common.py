import random
import re

import numpy as np
from pyspark.sql import functions as F

from quernstone.llm import common
from quernstone.llm.components import components


def test_words_and_hashes_against_regex():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aBc \t\n\x0b\x0c\r\x85é") for _ in range(rng.randrange(30))) for _ in range(300)] + ["", "x" * (common.SEGMENT + 5), "Y" * (common.SEGMENT + 5)]
    raw = [t.encode() for t in texts]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    cuts = np.cumsum([len(r) for r in raw])
    starts, ends = common.word_bounds(buf, cuts)
    words = [bytes(buf[a:b]) for a, b in zip(starts, ends)]
    assert words == [w for r in raw for w in re.findall(rb"[^\x20\x09-\x0D]+", r)]
    hashes = common.word_hashes(buf, starts, ends).tolist()
    by_word = {}
    for w, h in zip(words, hashes):
        assert by_word.setdefault(w.lower(), h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_pieces_cover_all():
    texts = [b"x" * n for n in (0, 5, 900, 3, 0, 2000, 1)]
    got = list(common.pieces(texts, 1000))
    assert [i for a, b in got for i in range(a, b)] == list(range(len(texts)))


def test_attach_hot_and_cold(spark):
    rows = spark.createDataFrame([("h" if i % 3 == 0 else f"k{i}", i) for i in range(300)], "key string, i int")
    groups = rows.groupBy("key").agg(F.count("*").alias("group_size"))
    got = common.attach(rows, groups, "key", 300, most=10)
    assert sorted((r["i"], r["group_size"]) for r in got.collect()) == [(i, 100 if i % 3 == 0 else 1) for i in range(300)]


def test_components_both_ways(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = {r[0]: r[1] for r in components(df).collect()}
    assert {r[0]: r[1] for r in components(df, one_task=0).collect()} == one
    for a, b in edges:
        assert one[a] == one[b] <= a
    assert components(df.limit(0)).count() == 0 and components(df.limit(0), one_task=-1).count() == 0
