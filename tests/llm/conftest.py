import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "Many words in one very long text, again and again different: " + " ".join(f"word{i} item{i * 7 % 1009}." for i in range(20_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns with clashing names."""
    rows = [
        (1, None, "en", "s", None), (2, "", None, None, 0), (3, " \n\t ", "en", "s", 4), (4, "word", "en", None, 4), (5, LONG, "en", "s", len(LONG)),
        (6, "Ünïcödé – 你好 😀 don't", None, "s", 20), (7, "same row", "en", "s", 8), (7, "same row", "en", "s", 8), (8, "one id", "en", "s", 6), (8, "two texts", "en", "s", 9),
        (None, "no id at all", "en", "s", 12), (None, None, None, None, None), (9, "a" * 5000, "en", "s", 5000), (10, "!!! ??? ...", "en", "s", 11),
    ]
    names = ["_id", "label", "half", "size", "whole", "bands", "sketch", "group", "part", "n", "key", "start", "words", "runs", "_runs", "shard", "window", "n_tokens", "toxic", "score", "keep"]
    df = spark.createDataFrame(rows, DOCS)
    for k, name in enumerate(names):
        df = df.selectExpr("*", f"CAST({k} AS STRING) AS `{name}`")
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1), (7, 0, 0), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
