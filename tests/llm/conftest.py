import pytest

LONG = "alpha beta gamma delta " * 6000
CASES = [(1, "The cat sat on the mat by the door."), (2, "The cat sat on the mat by the door."), (3, None), (4, ""), (5, LONG), (6, "one two"), (6, "one two"), (None, "a row without id but with words in it"), (7, "héé ÀB \t\r\n  ẞ 漢字 😀 'll")]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [(d, t, None if i % 3 else "en", None, None if t is None else len(t), i, "x", 0, 0) for i, (d, t) in enumerate(CASES)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, shard string, n_shingles int, score int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def small(spark):
    return "/root/testdata/sf0.001"
