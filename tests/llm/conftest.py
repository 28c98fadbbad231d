import pytest


@pytest.fixture
def docs(spark):
    """Builds a documents table from (doc_id, text) or (doc_id, text, lang, source), with columns whose names clash."""

    def make(rows):
        full = [(*r, *("en", "src0")[len(r) - 2 :]) if len(r) < 4 else r for r in rows]
        return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 7, "x", "y", 8) for r in full], "doc_id long, text string, lang string, source string, n_chars long, n long, key string, doc string, h int")

    return make
