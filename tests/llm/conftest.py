import pytest

#: Nulls, empty and very long texts, repeated rows, ties, odd characters.
TEXTS = [
    None, "", " \n ", "one", "The quick brown fox jumps over the lazy dog. " * 3, "x" * 5000, "a b " * 40_000,
    "naïve ÉCOLE straße œuvre — “quoted” 你好 😀 e\u0301", "1234 56,78 it's we'LL\tI'm\r\n\u00a0end", "one",
    "The quick brown fox jumps over the lazy dog. " * 3, "<|endoftext|> İstanbul ΣΟΦΟΣ \x1c \x85 ½²", "...,!? --- ,.,",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows with clashing and extra columns, a repeated row and null ids."""
    rows = [(i, t, "en", "s", None, "x") for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "no id", None, None, 5, "y"), (None, None, None, None, None, None)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, ids string"
    ).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
