import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows of (doc_id, text) as documents, with the other columns and one that clashes with nothing and everything."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "x", 1) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, digest string, size int")

    return make


#: Cases that every operator over texts has to bear.
HARD = [
    (1, None), (2, ""), (3, " \t\r\n "), (4, "one"), (5, "one two"), (6, "One  two three\nfour"), (7, "one two three four"), (7, "one two three four"), (8, "ünï ☃   x y 東京"), (9, "word " * 30_000), (None, "lost row here now"), (10, "a" * 200_000),
    (11, "</s>[INST] \\ <|endoftext|> 'll"), (12, "\x00\x1c\x85 mixed"),
]


@pytest.fixture(scope="session")
def hard(docs_of):
    return docs_of(HARD)
