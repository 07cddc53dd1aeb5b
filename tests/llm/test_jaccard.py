import random
import re

import pytest

from quernstone.llm import op2_jaccard as op


def brute(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    links = [{j for j, b in enumerate(sets) if i != j and a and b and 100 * len(a & b) >= 70 * len(a | b)} for i, a in enumerate(sets)]
    out = []
    for i, (d, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((d, len(sets[i]), len(links[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def near_copies(seed, n=60):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("abcdefghijklmnopqrstuvwxyz")
    base = [[word() for _ in range(rng.choice([3, 8, 25, 60]))] for _ in range(8)]
    passage = [word() for _ in range(30)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [word()], [word(), w[k]]])
        if rng.random() < 0.3:
            w += passage
        rows.append((i, " ".join(w).title() if rng.random() < 0.2 else "  ".join(w)))
    return rows


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed,block", [(1, op.BLOCK), (2, 300), (3, 60)])
def test_links_and_components(docs_of, seed, block):
    rows = near_copies(seed)
    assert got(op.link(docs_of(rows), block)) == brute(rows)


def test_exactly_at_the_threshold(docs_of):
    w = [f"w{i}" for i in range(19)]  # 17 shingles; 14 of 20 in both is 70 %
    a, b = " ".join(w), " ".join(w[:16] + ["x", "y", "z"])
    rows = [(1, a), (2, b), (3, " ".join(w[:15] + ["p", "q", "r", "s"]))]
    assert got(op.link(docs_of(rows))) == brute(rows)
    assert brute(rows)[0][2] == 1


def test_hard_cases(docs_of, hard):
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    assert got(op.link(hard)) == brute(rows)
    assert op.link(hard.limit(0)).count() == 0


def test_hot_group_of_near_copies(docs_of):
    rows = [(i, " ".join(f"t{k}" if k != i % 40 else f"u{i}" for k in range(40))) for i in range(120)] + [(i, f"only {i} here {i * 7}") for i in range(120, 240)]
    assert got(op.link(docs_of(rows), 500)) == brute(rows)


def test_thin_keeps_one_of_each_group(docs_of):
    rows = near_copies(5)
    docs = docs_of(rows)
    kept = op.thin(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _, _, c in brute(rows) if d == c)


def test_rows_without_id_and_the_largest_id(docs_of):
    rows = [(None if i % 3 else i, t) for i, t in near_copies(1)] + [(2**63 - 1, "the last id there is"), (None, "a row alone with no id")]
    rows += [(5, rows[0][1]), (5, rows[0][1] + " more")]
    assert got(op.link(docs_of(rows))) == brute(rows)


def test_thin_without_ids_and_with_repeated_ones(docs_of):
    group = [" ".join(f"g{g}w{k}" for k in range(30)) for g in range(4)]
    rows = [(None, group[0] + f" x{i}") for i in range(6)]  # none has an id: one stays
    rows += [(None, group[1])] * 3 + [(9, group[1] + " y"), (4, group[1] + " z")]  # 4 stays
    rows += [(7, group[2] + " a"), (7, group[2] + " b"), (7, group[2] + " a")]  # one row of id 7 stays
    rows += [(None, group[3])] * 5 + [(None, None)] * 3 + [(None, "alone one two three")]  # one; all three; it
    docs = docs_of(rows)
    kept = op.thin(docs)
    assert kept.columns == docs.columns
    found = [(r["doc_id"], (r["text"] or "")[:4]) for r in kept.collect()]
    assert sorted(found, key=repr) == sorted([(None, "g0w0"), (4, "g1w0"), (7, "g2w0"), (None, "g3w0"), (None, ""), (None, ""), (None, ""), (None, "alon")], key=repr)


def test_hot_texts_without_id(docs_of):
    rows = [(None, "the same hot text without any id " * 3)] * 400 + [(None, f"row {i} of many with no id {i * 3}") for i in range(300)]
    assert got(op.link(docs_of(rows))) == sorted([(None, 7, 399, None)] * 400 + [r for r in brute(rows[400:])], key=repr)
    assert op.thin(docs_of(rows)).count() == 301


@pytest.mark.parametrize("block", [op.BLOCK, 90])
def test_chain_whose_prefixes_percolate(docs_of, block):
    """Windows over one long text: neighbours link, the next but one don't, and every prefix is shared by several; besides, the same text at very different sizes."""
    words = [f"w{i}" for i in range(900)]
    rows = [(i, " ".join(words[i * 6 : i * 6 + 40])) for i in range(60)] + [(100 + i, " ".join(words[: 12 * 2**i])) for i in range(6)]
    rows += [(200 + i, " ".join(words[400 + i : 445])) for i in range(20)]
    assert got(op.link(docs_of(rows), block)) == brute(rows)
