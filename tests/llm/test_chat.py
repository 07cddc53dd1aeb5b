import hashlib
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quernstone.llm import op4_chat as op

LOG = "conv_id long, seq long, kind string, msg string, role string, text string"


def test_rendering_is_reversible():
    rng = random.Random(4)
    bits = [*op.CONTROL, "\\", "<", ">", "[", "]", "/", "s", "a", "\n", "é", "<\\s>", "[\\INST]"]
    for _ in range(3000):
        turns = [(rng.choice(["user", "assistant", "system", "", "tool[SAYS]", "a\nb"]), "".join(rng.choice(bits) for _ in range(rng.randrange(9)))) for _ in range(rng.randrange(5))]
        made = [op.render(r, t) for r, t in turns]
        whole = "".join(m[0] for m in made)
        assert op.parse(whole) == turns
        for (r, t), (s, a, b) in zip(turns, made):
            assert op.unescape(s[a:b]) == (t if r == "assistant" else "")
        bodies = [op.escape(t) for _, t in turns]
        assert not any(c in b for b in bodies for c in op.CONTROL)


def test_folding_events(spark):
    rows = [
        (1, 1, "message", None, "user", "hi"),
        (1, 2, "delta", "m", "assistant", "He"), (1, 4, "delta", "m", None, "llo"),
        (1, 3, "delta", "x", "assistant", "gone"), (1, 5, "delete", "x", None, None),
        (1, 6, "message", "u", "user", "q1"), (1, 7, "edit", "u", None, "q2"),
        (1, 8, "delta", "r", "assistant", "bad"), (1, 9, "regenerate", "r", None, None), (1, 10, "delta", "r", None, "good"), (1, 11, "delta", "r", None, "!"),
        (2, 1, "message", None, None, None), (None, 1, "message", None, "user", "lost"),
    ]
    rows = rows[::-1]
    got = [tuple(r) for r in op.messages(spark.createDataFrame(rows, LOG)).orderBy("conv_id", "seq").collect()]
    assert got == [(None, 1, "user", "lost"), (1, 1, "user", "hi"), (1, 2, "assistant", "Hello"), (1, 6, "user", "q2"), (1, 8, "assistant", "good!"), (2, 1, "", "")]


def brute(conversations):
    out = {}
    for conv, turns in conversations.items():
        mine = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(mine), hashlib.sha256(mine.encode()).hexdigest(), sum(len(op.render(r, t)[0]) for r, t in turns))
    return out


def test_summary_of_hot_and_odd_conversations(spark):
    rng = random.Random(5)
    conversations = {7: [(rng.choice(["user", "assistant"]), "x" * rng.randrange(50)) for _ in range(900)], 1: [("system", op.ATTACK), ("assistant", op.ATTACK), ("assistant", "")], 2: [("user", "é☃")], 3: [("assistant", "y" * 300_000)]}
    rows = [(c, i, "message", None, r, t) for c, turns in conversations.items() for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    log = spark.createDataFrame(rows, LOG).withColumn("rendered", F.lit(1))
    assert {r[0]: tuple(r)[1:] for r in op.summary(log).collect()} == brute(conversations)
    assert op.summary(log.limit(0)).count() == 0
    turns = op.turns(op.messages(log)).where("conv_id = 1").orderBy("seq").collect()
    assert "".join(r["rendered"] for r in turns) == "".join(op.render(*t)[0] for t in conversations[1])


def test_ties_and_repeats(spark):
    rows = [(1, 0, "message", None, "user", "b"), (1, 0, "message", None, "user", "a"), (1, 0, "message", None, "user", "a"), (1, 0, "message", None, "assistant", "z")]
    got = op.summary(spark.createDataFrame(rows, LOG)).first()
    assert tuple(got)[1:] == brute({1: [("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")]})[1]


def test_reader_of_pieces_cut_anywhere():
    rng = random.Random(6)
    bits = [*op.CONTROL, "\\", "<", "[", "s>", "é", "word "]
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "system", "", "tool", "[ROLE]"]), "".join(rng.choice(bits) for _ in range(rng.randrange(12)))) for _ in range(rng.randrange(6))]
        whole = "".join(op.render(*t)[0] for t in turns)
        reader, got, at = op.Reader(), [], 0
        while at < len(whole):
            n = rng.randrange(1, 12)
            got += reader.feed(whole[at : at + n])
            at += n
        got += reader.feed("", last=True)
        assert [(r, op.unescape(raw)) for r, raw, _ in got] == turns
        assert all(whole[at : at + len(raw)] == raw for _, raw, at in got)


@pytest.mark.parametrize("broken", ["x", "[INST]a", "[INST]a</s>", "</s>", "<s>a</s>b", "[ROLE]x[/ROLE]", "[SAYS]"])
def test_broken_conversations_are_noticed(broken):
    with pytest.raises(ValueError):
        op.parse(broken)


def test_streamed_log_folds_into_the_turns(spark):
    rng = random.Random(7)
    texts = ["", None, "a", "ab", "é☃ 😀 long " * 900, op.ATTACK, "x" * 19, "y" * 400_000]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(texts)) for c in (*range(12), None) for t in (*range(5), 3, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "7 as msg", "8 as kind", "9 as step")
    log = op.streamed(df)
    assert {"delta", "edit", "regenerate", "message"} == {r["kind"] for r in log.select("kind").distinct().collect()}
    got = sorted((tuple(r) for r in op.messages(log).collect()), key=repr)
    assert got == sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=repr)
    conversations = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        conversations.setdefault(c, []).append((r or "", x or ""))
    assert {r[0]: tuple(r)[1:] for r in op.summary(log).collect()} == brute(conversations)


def test_query_with_its_sql_and_the_extra_conversation(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.exists(folder):
        pytest.skip("no test data")
    df = op.query(spark, folder)
    got = {r["conv_id"]: tuple(r[c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")) for r in df.collect()}
    db = duckdb.connect()
    db.execute(f"create view conversations as select * from '{folder}/conversations.parquet'")
    want = db.sql(op.SQL)
    rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
    assert got == {r["conv_id"]: tuple(r[c] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")) for r in rows}
    assert got[-1] == brute({-1: [("user", op.ATTACK), ("assistant", op.ATTACK)]})[-1]
    plan = df._jdf.queryExecution().toString()
    assert plan.count("hashpartitioning(conv_id") >= 2  # the fold's exchange and the conversations'
