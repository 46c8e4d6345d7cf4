import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """Rows -> DataFrame; documents get the other columns filled in."""
    def build(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)
    return build


@pytest.fixture
def documents(spark):
    def build(texts, source=lambda i: f"s{i % 3}"):
        rows = [(i, t, "en", source(i), None if t is None else len(t)) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOC)
    return build


