import pytest

LONG = "lorem ipsum dolor sit amet " * 8000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ids, extra columns with clashing names."""
    rows = [
        (1, "plain words, it's 42 <|endoftext|> end", "en", "a", 10, 0.5, "x"),
        (2, None, None, None, None, None, None),
        (3, "", "en", "a", 0, 1.0, "y"),
        (4, LONG, "en", "b", len(LONG), 0.0, "z"),
        (5, "same text", "en", "b", 9, 0.1, "z"),
        (5, "same text", "en", "b", 9, 0.1, "z"),
        (6, "same text", "de", "c", 9, 0.1, "z"),
        (None, "no id é ü ß 日本語 😀 ñ", "fr", "c", 5, 0.2, "w"),
        (7, " \t\n\r\n  ", "fr", "c", 5, 0.2, "w"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, digest string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
