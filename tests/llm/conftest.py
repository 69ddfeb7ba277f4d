import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def table(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="session")
def docs(table):
    return table("documents")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a very long one, ties."""
    words = [f"w{k % 997}x" for k in range(30_000)]
    rows = [(1, "alpha beta gamma delta epsilon", "en", "a", 5), (1, "alpha beta gamma delta epsilon", "en", "a", 5),
            (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n ", "en", None, 4), (None, "alpha beta", None, "b", 10),
            (5, " ".join(words), "de", "b", 1), (6, "1234 5678", "fr", "", 9), (7, "é<|endoftext|> x", "fr", "b", 9)]
    return spark.createDataFrame(rows, DOCS)
