import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, n string, seed string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) pairs, with a column that clashes with inner names and nulls elsewhere."""
    def make(rows, schema=DOCS):
        width = len(schema.split(","))
        full = [(*r, *[None] * (width - len(r) - 2), "own", "own")[:width] for r in rows]
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def sample():
    return "/root/testdata/sf0.001"
