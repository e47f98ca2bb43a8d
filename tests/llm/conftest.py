import pytest

#: Nulls, empty and blank texts, ties, repeated rows, very long texts, odd white space, other scripts.
TEXTS = [None, "", " \n", "a", "Ab  b", "it's they'll ' re", "x" * 5000, "é\n\n漢字 a\tb ", "<|endoftext|> a<|startoftext|>", "the cat sat. " * 400, "The cat sat on the mat, twice!", "The cat sat on the mat, twice!", "mail a.b@c.de or +1 (736) 555-2678", "12 3.4.5.6 !! ?!"]


@pytest.fixture(scope="session")
def docs(spark):
    """Clashing extra columns, one null id, one repeated row."""
    rows = [(i, t, "en", f"s{i % 2}", len(t or ""), "x", 7) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", None, None, None, None, None), rows[10]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, start string, shard int")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
