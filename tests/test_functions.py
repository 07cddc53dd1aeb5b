import unicodedata

import pytest
from pyspark.sql import functions as F

from quernstone.functions import spelling, stemming, text
from quernstone.functions.stemming import english, stem, stem_of, stemmed

STEMS = {
    "consigned": "consign", "consistency": "consist", "knackeries": "knackeri", "caresses": "caress", "flies": "fli", "ties": "tie", "denied": "deni", "agreed": "agre", "hopping": "hop", "hoping": "hope",
    "national": "nation", "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope",
    "formality": "formal", "sensibility": "sensibl", "electrical": "electr", "goodness": "good", "adjustment": "adjust", "replacement": "replac", "adoption": "adopt", "effective": "effect", "probate": "probat",
    "rate": "rate", "controlling": "control", "rolling": "roll", "happy": "happi", "say": "say", "skies": "sky", "news": "news", "generously": "generous", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi",
    "succeed": "succeed", "proceeding": "proceed", "dying": "die", "early": "earli", "luxuriated": "luxuri", "bled": "bled", "sing": "sing", "yes": "yes",
}


@pytest.mark.parametrize("word", STEMS)
def test_english_stems(word):
    assert english(word) == STEMS[word]


def test_stem_leaves_short_and_long_tokens():
    assert stem("as", ("english",)) == "as" and stem("x" * 41 + "ing", ("english",)).endswith("ing")


def test_stem_columns(spark):
    df = spark.createDataFrame([("running", 1), ("runs", 2), ("running", 3), (None, 4)], "term string, n int")
    assert {r[0] for r in df.select(stem_of("term")).collect()} == {"run", None}
    assert sorted(r["n"] for r in stemmed(df.where("term is not null")).where("term = 'run'").collect()) == [1, 2, 3]


def _fnv(s: str) -> int:
    h = 2166136261
    for b in s.encode():
        h = (h ^ b) * 16777619 % 2**32
    return h


def test_shard_hash_and_spread(spark):
    ids = ["", "a", "foobar", "åäö", *(str(i) for i in range(1000))]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    got = {r[0]: r[1] for r in df.select("id", text.fnv1a(F.col("id"))).collect()}
    assert got == {i: _fnv(i) for i in ids} and got["foobar"] == 0xBF9CF968
    sizes = [r[1] for r in df.groupBy(text.shard_of(F.col("id"), 5)).count().collect()]
    assert len(sizes) == 5 and min(sizes) > len(ids) / 5 * 2 / 3


def test_tokens_and_spans_agree(spark):
    texts = ["Hello, World! 3.14 a I x2", "Rökare_x ½ 東京 ﬁ straße", "", "a b c 7", "tab\tnew\nline", "ÀÉ é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", text.tokens(F.col("t")).alias("x")).collect():
        assert r["x"] == text.words_of(r["t"])
    assert text.words_of("3.14 a") == ["3", "14"]
    assert text.excerpt("One, two; three-four!", 1, 2) == "two; three"


def test_extra_token_characters_and_separators(spark):
    df = spark.createDataFrame([("foo_bar baz-x1",)], "t string")
    assert df.select(text.tokens(F.col("t"), extra="_")).first()[0] == ["foo_bar", "baz", "x1"]
    assert df.select(text.tokens(F.col("t"), separators="o")).first()[0] == ["bar", "baz", "x1"]


def test_fold():
    assert text.fold("Rökare") == "Rokare" and text.fold("straße") == "straße" and text.fold("é") == "e"


def test_blob_codec(spark):
    for s in ("", "x", "å" * 100, "z" * 20000):
        z = text.compress(s)
        assert z[0] == 0xF8 and text.uncompress(z) == s
        assert text.iscompressed(z) == (s != "")
    assert text.uncompress(b"plain") == "plain" and not text.iscompressed(b"\xf8") and text.compress(None) is None
    big = text.compress("z" * 300)
    assert big[1:3] == bytes([300 >> 7, 0x80 | 300 & 0x7F])
    df = spark.createDataFrame([("abc",), (None,)], "t string")
    assert [r[0] for r in df.select(text.uncompress_of(text.compress_of("t"))).collect()] == ["abc", None]


def test_versions(spark):
    df = spark.createDataFrame([("1.2.3", "1.3"), ("2", "1.9.9"), ("x", "1")], "a string, b string")
    rows = df.select(text.compatible(F.col("a"), F.col("b")), text.newer(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in rows] == [(True, False), (False, True), (None, None)]


def test_metrics_packing(spark):
    df = spark.createDataFrame([('{"a": 1, "b": 2.5}',)], "j string")
    assert df.select(text.unpack_metrics(text.pack_metrics("j"))).first()[0] == {"a": 1.0, "b": 2.5}
    assert text.si(1500) == "1.5k" and text.si(3) == "3"


def test_phonehash():
    assert spelling.phonehash("hello") == spelling.phonehash("helo")
    assert spelling.phonehash("knight") == spelling.phonehash("night") and spelling.phonehash("wright") == spelling.phonehash("right")
    assert spelling.phonehash("") == "" and spelling.phonehash(None) is None
    assert spelling.phonehash("catch") == spelling.phonehash("cach") == "CAC"
    assert spelling.phonehash("a1b2") == "A9B9"


def test_editdist():
    e = spelling.editdist
    assert e("abc", "abc") == 0 and e("abc", "ABC") == 0
    assert e("hello", "helo") == 10  # one of two equal letters
    assert e("cat", "cast") == 100 and e("cat", "cabt") == 100
    assert e("color", "colour") == 20 and e("boat", "bat") == 55  # vowels
    assert e("cat", "cats") == 25  # an ending is cheap
    assert e("pat", "bat") == 40 and e("cat", "bat") == 75
    assert e("ab*", "abcdef") == 0 and e("é", "e") == -2 and e(None, "x") is None
    assert e("", "h") == 0 and e("rst", "") > 0


def test_editdist3():
    assert spelling.editdist3("kitten", "sitting") == 400
    assert spelling.editdist3("ss", "ß", {("ss", "ß"): 8}) == 8
    assert spelling.editdist3("a", "b", {("?", "?"): 30}) == 30 and spelling.editdist3("ab*", "abzz") == 0


def test_translit():
    assert spelling.translit("Größe Ærø naïve ЖЩ ﬁ 東") == "Groesse AEro naive ZhShch fi ?"
    for c in "ÀÉîõç":
        assert spelling.translit(c) == unicodedata.normalize("NFD", c)[0]


def test_scripts(spark):
    words = {"abc": 215, "123": 215, "où": 215, "привет": 220, "λόγος": 200, "שלום": 125, "سلام": 160, "abcпр": 998, "!!": 999, "": 999, "東": 999}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r[0]: r[1] for r in df.select("w", spelling.scriptcode_of(F.col("w"))).collect()} == words


def test_score(spark):
    df = spark.createDataFrame([(10, 0), (10, 1), (10, 255), (10, 256)], "d long, r long")
    got = [r[0] for r in df.select(spelling.score_of(F.col("d"), F.col("r"))).collect()]
    assert got == [spelling.score(10, r) for r in (0, 1, 255, 256)] == [42, 41, 34, 33]


def test_german_stems():
    """Pairs from the sample vocabulary that the stemmer's authors publish."""
    pairs = "aufeinander aufeinand, aufeinanderfolge aufeinanderfolg, aufeinanderfolgen aufeinanderfolg, aufeinanderschlügen aufeinanderschlug, kategorie kategori, kategorien kategori, kategorisch kategor, kategorische kategor, kater kat, kauf kauf, kaufe kauf, kaufen kauf, käufer kauf, kaum kaum, kehrte kehrt, häuser haus, freundlichkeit freundlich, bauen bau"
    for a, b in (p.split() for p in pairs.split(", ")):
        assert stemming.german(a) == b, a
    assert stemming.stem("käufer", ("german",)) == "kauf" and stemming.stem("running", ("english", "german")) == "run"
