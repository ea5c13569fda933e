import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, fp string"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table of texts, with null columns and columns of clashing names."""

    def make(texts, start=0):
        rows = [(start + i, t, None, f"s{i % 3}" if i % 4 else None, None, "k", "f") for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make
