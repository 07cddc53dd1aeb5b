import hashlib
import random
from collections import defaultdict

import pytest

from quernstone.llm import op5_dedup as op


def norm(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[norm(t)].append(d)
    out = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        kept = False
        for d in ids:
            stays = d == keep and not kept
            kept |= stays
            out.append((d, keep, len(ids), stays, sha))
    return sorted(out, key=repr)


@pytest.mark.parametrize("counters", [256, 2])
def test_groups(docs_of, hard, monkeypatch, counters):
    monkeypatch.setattr(op, "COUNTERS", counters)
    rng = random.Random(6)
    rows = [(i, rng.choice(["Hot TEXT", "hot text", "É", "é", f"own {i}", f"pair {i // 2}", None, ""])) for i in range(500)]
    rows += [(r["doc_id"], r["text"]) for r in hard.collect()]
    assert sorted(map(tuple, op.classify(docs_of(rows)).collect()), key=repr) == brute(rows)


def test_sketch_holds_every_heavy_hitter():
    rng = random.Random(7)
    values = [1] * 400 + [2] * 200 + [rng.randrange(10**9) for _ in range(600)]
    rng.shuffle(values)
    import pyarrow as pa

    parts = [[pa.RecordBatch.from_arrays([pa.array(values[o : o + 50], pa.int64())], ["head"]) for o in range(s, s + 300, 50)] for s in range(0, 1200, 300)]
    total = defaultdict(int)
    for p in parts:
        for b in op._sketch(iter(p)):
            assert b.num_rows <= op.COUNTERS
            for x, n in zip(*(c.to_pylist() for c in b.columns)):
                total[x] += n
    top = sorted(total, key=total.get, reverse=True)[:2]
    assert set(top) == {1, 2} and total[1] <= 400


def test_deduplicate_keeps_whole_rows(docs_of, hard):
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()] + [(20, "ONE"), (21, "oNe"), (7, "another text of seven")]
    docs = docs_of(rows)
    out = op.deduplicate(docs)
    assert out.columns == docs.columns
    want = sorted(((d, h) for d, _, _, stays, h in brute(rows) if stays), key=repr)
    assert sorted(((r["doc_id"], hashlib.sha256(norm(r["text"]).encode()).hexdigest()) for r in out.collect()), key=repr) == want
    assert op.deduplicate(docs.limit(0)).count() == 0
    assert op.deduplicate(docs_of([(1, "a"), (2, "b")])).count() == 2
