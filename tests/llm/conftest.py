import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, _key string, _q_w string, rank int"
LONG = " ".join(f"word{i % 997} the" for i in range(20_000))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows, and columns with names that operators use."""
    rows = [
        (None, "a text without an id that is long enough to keep", "en", "s1"), (1, None, "en", "s1"), (2, "", "en", None), (3, " \n\t ", None, "s2"), (4, "word", "en", "s2"), (4, "word", "en", "s2"),
        (5, LONG, "en", "s1"), (6, "the end of it all is near. " * 6, "en", "s3"), (7, "the end of it all is near. " * 6, "en", "s3"), (8, "naïve ﬁ İstanbul \U0001f600 é “quotes” <|endoftext|> all rights reserved", "fr", "é"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), 0.5, 1, "k", "q", 1) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
