import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a table of documents from (doc_id, text[, lang[, source]]) rows."""

    def make(*rows):
        full = [(*r, *(None,) * (4 - len(r)), len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(3)

    return make


@pytest.fixture
def odd(docs):
    """Nulls, empty and very long texts, ties, repeated rows, odd characters."""
    return docs(
        (1, None, None, None),
        (2, "", "en", "a"),
        (None, "Null id, some words of text here", "en", "a"),
        (4, "The cat sat on the mat " * 20_000, "en", "a"),
        (5, "the CAT sat", "en", None),
        (6, "The cat sat", "en", "b"),
        (6, "The cat sat", "en", "b"),
        (7, " \n\t ", "en", "b"),
        (8, "é日本😀<|endoftext|>   x y", "fr", "b"),
        (9, "12345 !!!", None, "c"),
    )
