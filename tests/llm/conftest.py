import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows, ties, clashing names."""
    long = " ".join(f"w{i % 977}x{i * 7919 % 10007}" for i in range(20000))
    rows = [
        (1, "one two three four five six seven eight nine ten", "en", "s", 1, "k", 0.5),
        (1, "one two three four five six seven eight nine ten", "en", "s", 1, "k", 0.5),
        (2, "One, two three four five six seven eight nine TEN!", None, None, None, None, None),
        (3, None, "en", "s", None, "k", 0.1),
        (4, "", "en", "s", 0, "k", 0.1),
        (5, " \n\t ", "en", "s", 4, "k", 0.1),
        (None, "one two three four five six seven eight nine ten", "en", "s", 1, None, None),
        (None, None, None, None, None, None, None),
        (6, long, "en", "hot", len(long), "k", 0.9),
        (7, long + " tail", "en", "hot", len(long) + 5, "k", 0.9),
        (8, "hi", "en", "s", 2, "k", 0.2),
        (9, "é中文 ☃ hi", "xx", "s", 7, "k", 0.2),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, score double")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(1, 1, 0), (1, 0, 0), (2, 1, None), (3, 0, 0), (4, 0, 1), (None, 1, 1), (6, 1, 0), (7, None, 0), (8, 0, 0), (9, 0, 0), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
