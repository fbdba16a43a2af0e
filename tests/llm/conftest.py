import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with columns whose names clash with the operators' own."""

    def make(pairs):
        rows = [(i, t, "en", "s", None if t is None else len(t), 1, "k") for i, t in pairs]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n int, key string")

    return make
