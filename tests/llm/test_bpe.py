import hashlib
import random

import numpy as np
import pytest
import tiktoken

from quernstone.llm import op8_bpe as op


@pytest.fixture(scope="module")
def tok():
    return op.Tokenizer(*op.public())


@pytest.fixture(scope="module")
def reference(tok):
    return tiktoken.Encoding("own", pat_str=op.public()[1], mergeable_ranks=tok.ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_exact(tok):
    keys = list(tok.ranks)
    assert sorted(tok.hash.slot_key.tolist()) == list(range(len(keys)))
    assert tok.hash.find(keys).tolist() == list(range(len(keys)))
    assert set(tok.hash.find([k + b"\xff\xfe" for k in keys[:3000]]).tolist()) == {-1}
    assert op.PerfectHash([]).find([b"x"]).tolist() == [-1] and op.PerfectHash([b"x"]).find([b"x", b"y"]).tolist() == [0, -1]


def test_ids_equal_tiktoken(tok, reference):
    rng = random.Random(10)
    chars = [*map(chr, range(32, 127)), *"\n\t\r \x0b\x0c\x1c\x85\xa0 　éßжλ東한ﷺ😀́½٣", "'s", "'ll", "<|endoftext|>"]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["", "a" * 5000, "ab" * 3000, " " * 700, "x\n\n\n  y"]
    ids, ends = tok.encode(texts)
    for t, part in zip(texts, np.split(ids, ends[:-1])):
        assert part.tolist() == reference.encode_ordinary(t)
        assert tok.decode(part.tolist()) == t.encode()


def test_memo_may_be_forgotten(tok, reference, monkeypatch):
    monkeypatch.setattr(op, "MEMO_BYTES", 600)
    for t in ("one two three four", "five six seven", "one two"):
        assert tok.encode([t])[0].tolist() == reference.encode_ordinary(t)


def test_columns_and_round_trip(hard, reference):
    rows = hard.collect()
    out = op.encode(hard, *op.public(), ids=True)
    by_text = {}
    for r in rows:
        by_text.setdefault(r["doc_id"], set()).add(r["text"] or "")
    for r in out.collect():
        texts = {t for t in by_text[r["doc_id"]] if reference.encode_ordinary(t) == r["ids"]}
        assert texts and r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] in {hashlib.sha256(t.encode()).hexdigest() for t in texts}
    back = op.decode(out, *op.public()).collect()
    assert sorted(bytes(r["text"]) for r in back) == sorted((r["text"] or "").encode() for r in rows)
    assert op.encode(hard.limit(0), *op.public()).count() == 0
