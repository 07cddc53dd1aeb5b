import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from quernstone.llm import op1_toxicity, op3_mix, op8_bpe
from tests.llm.test_dedup import norm
from tests.llm.test_jaccard import brute as near_brute
from tests.llm.test_toxicity import corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(14)
    rows = [(i, t, y) for i, t, y in corpus(300, 3)]
    texts = [t for _, t, y in rows if not y and len(t.split()) > 30]
    rows += [(1000 + i, rng.choice(texts[:5]).upper(), 0) for i in range(20)]
    rows += [(1100 + i, t + " and more", 0) for i, t in enumerate(texts[:15])]
    rows += [(1200, "", 0), (1201, None, 0)]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, t, "en", f"src{i % 4}" if i % 9 else None, len(t or "")) for i, t, _ in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_run_against_the_stages_by_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    model = op1_toxicity.fit(docs, labels)
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    # 1
    scores = dict(zip((r[0] for r in rows), model.scores([r[1] or "" for r in rows])))
    rows = [r for r in rows if scores[r[0]] < op1_toxicity.THRESHOLD]
    assert {r["doc_id"] for r in docs.collect()} - {r[0] for r in rows} and sum(r["toxic"] for r in labels.collect() if r["doc_id"] in {x[0] for x in rows}) <= 3
    # 2
    last = {}
    for r in rows:
        last[norm(r[1])] = max(last.get(norm(r[1]), -1), r[0])
    rows = [r for r in rows if last[norm(r[1])] == r[0]]
    # 3
    keep = {d for d, _, _, c in near_brute([r[:2] for r in rows]) if d == c}
    rows = [r for r in rows if r[0] in keep]
    # 4: the copies are drawn, so only those of run() are taken from the operator; its sums are tested in test_mix
    left = docs.where(docs["doc_id"].isin(list(keep)))
    copies = {r["doc_id"]: r["copies"] for r in op3_mix.mix(left).collect()}
    assert set(copies) == keep
    # 5
    path, pattern = op8_bpe.public()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=op8_bpe.tokenizer(path, pattern).ranks, special_tokens={})
    want = Counter()
    for d, t, _ in rows:
        ids = enc.encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += copies[d]
    out = corpus_pipeline.run(spark, folder).collect()
    assert Counter(tuple(r)[:4] for r in out) == +want
    assert all(hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() == r["ids_sha256"] for r in out)


def test_stages_keep_columns_and_bear_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.ORACLE_SQL is None


def test_run_with_nulls_repeats_and_clashing_columns(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(None, text + f" x{i}", None, None, i, "h") for i in range(5)] + [(None, None, "en", "a", 1, None)] * 3 + [(7, "", "en", "a", 2, "d")] * 2 + [(8, text.upper(), "en", "b", 3, "d")]
    rows += [(9, " ".join(f"own{i}" for i in range(40)), None, "a", None, None)] * 3 + [(9, "another text of the same id", None, "a", None, None)]
    rows += [(10, "very long " * 60_000 + " ".join(f"z{i}" for i in range(9)), "en", "b", 4, "x")]
    schema = "doc_id long, text string, lang string, source string, size long, digest string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    deduplicated = corpus_pipeline.exact_dedup(spark, docs, str(tmp_path))
    # one of the rows without text, five texts without id, 8, two texts of 9, 10
    assert deduplicated.count() == 10
    thinned = corpus_pipeline.near_duplicates(spark, deduplicated, str(tmp_path))
    assert sorted((r["doc_id"] for r in thinned.collect()), key=repr) == sorted([7, 8, 9, 9, 10], key=repr)
    taken = corpus_pipeline.mix_sources(spark, thinned, str(tmp_path))
    assert taken.columns == docs.columns
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(r["doc_id"] for r in taken.collect())
    assert {r["n_tokens"] == len(r["ids"]) for r in out} == {True}
