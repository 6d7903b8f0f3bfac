import pytest


@pytest.fixture(scope="session")
def make(spark):
    """A documents table with a clashing and an odd extra column."""
    def rows(texts, ids=None):
        ids = ids or range(len(texts))
        return spark.createDataFrame([(i, t, "x", 1) for i, t in zip(ids, texts)], "doc_id bigint, text string, key string, n int")
    return rows
