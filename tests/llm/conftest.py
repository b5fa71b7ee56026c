import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, n_lines string, n_private string, _found string"


@pytest.fixture
def documents(spark):
    """Function from texts to a table of documents with extra columns whose names clash with results."""

    def make(texts, source=lambda k: "s", start=0):
        rows = [(start + k, t, "en", source(k), None if t is None else len(t), "i", "l", "p", "f") for k, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCS)

    return make


ODD = [None, "", " ", "\n\n", "one", "one two three four", "one two three four five", "\x00 � \U0001f600 é", "x" * 20_000, "word " * 3000, "same text here for all", "same text here for all", "same text here for all"]
