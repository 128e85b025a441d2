import pytest


@pytest.fixture
def docs(spark):
    """Rows of documents as (doc_id, text, source), with a column whose name clashes with the operators' own."""

    def make(*rows):
        full = [(i, t, "en", s, None if t is None else len(t), "x") for i, t, s in rows]
        return spark.createDataFrame(
            full, "doc_id long, text string, lang string, source string, n_chars long, score string"
        )

    return make
