import pytest

HARD = [None, "", " \n\t ", "a", "Same words here now again", "Same words here now again", "\\### Assistant: </turn> <x> ok", "é" * 3000 + " " + "w " * 3000, "x" * 50000]


@pytest.fixture(scope="session")
def odd(spark):
    """Null and empty texts, a very long text and a very long word, repeated rows, a null id and columns with clashing names."""
    rows = [(i, t, "en", "s", 1, "c", 2.0, False) for i, t in enumerate(HARD)] + [(1, "", "en", "s", 1, "c", 2.0, True), (None, "no id at all", None, None, None, None, None, None), (3, "a", "en", "s", 1, "c", 2.0, False)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, word string, score double, kept boolean")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
