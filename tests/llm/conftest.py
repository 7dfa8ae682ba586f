import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, n string, words string"


@pytest.fixture
def docs(spark):
    """A documents table with clashing further columns, from (doc_id, text) rows."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, None, None, 0.5, 7, "x", "y") for i, t in rows], DOCS)

    return make


#: Nulls, empty and odd texts, ties and repeated rows.
AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "word"), (5, "word"), (6, "a b c d e f " * 3000), (7, "\x00 naïve 日本語 🙂 \u2028 x"), (None, "no id here at all"), (8, "x" * 200_000)]


@pytest.fixture
def awkward(docs):
    return docs(AWKWARD)
