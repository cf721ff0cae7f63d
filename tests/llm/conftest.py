import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """rows: (doc_id, text, source); with two columns whose names clash with the operators' own."""
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA)
    return df.selectExpr("*", "'x' AS name", "1 AS kept", "2L AS size")


LONG = "lorem ipsum dolor sit amet " * 12000


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank and very long texts, null ids and sources, repeated rows."""
    return [(1, None, "a"), (2, "", None), (3, " \n\t ", "a"), (4, LONG, "b"), (5, "one two", None), (5, "one two", None), (None, "no id here", "c"), (7, "Grüße 😀 naïve", "a")]
