import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, u long, at long, block long, size long"


@pytest.fixture(scope="session")
def make(spark):
    """A table of documents with extra columns whose names clash with those of the operators."""

    def build(rows):
        full = [(r[0], r[1], *(r[2:4] or (None, None)), None if r[1] is None else len(r[1]), "x", 1, 2, 3, 4) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build
