import pytest

DOCS = "doc_id long, text string, source string, lang string, _mix string, fp long, u long, label int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, equal texts, clashing column names."""
    long = "word " * 30_000 + "me@site.org 4111 1111 1111 1111 " + "tail " * 2_000
    body = "one two three four five six seven eight nine ten"
    rows = [
        (1, body, "a"), (2, body, "a"), (2, body, "a"), (3, body.upper(), "b"), (4, None, "b"), (5, "", None), (6, " \t\n", None), (7, long, "c"),
        (None, "no id here", "a"), (None, None, None), (8, "x", "a"), (9, "Mail bob@x.org or +1 (555) 123-4567 now, 10.0.0.255", "é"), (10, "é\U0001f600 a@b.co", "z"),
    ]
    return spark.createDataFrame([(i, t, s, "en", "old", 5, 6, 7) for i, t, s in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
