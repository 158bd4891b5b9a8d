import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd_rows(spark):
    """Nulls, empty and long texts, repeated rows, a null key, and columns whose names operators use inside."""
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", "a", 0),
        (3, "the same words here again " * 12, "en", "a", 1),
        (3, "the same words here again " * 12, "en", "a", 1),
        (4, "x" * 70_000 + " end", "en", "a", 1),
        (5, "One two three four five. Ünïcode 日本 text\n\n<|endoftext|> q@w.io", None, None, None),
        (None, "a text without a key, which is a row all the same", "en", "a", 1),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for name in ("key", "text_", "shard", "fp", "pii", "_pii", "_email", "kept", "v", "id"):
        df = df.selectExpr("*", f"'x' as {name}")
    return df


@pytest.fixture(scope="module")
def no_rows(spark):
    return spark.createDataFrame([], DOCS)
