import pytest

SF = "/root/testdata/sf0.001"

#: Extra columns that operators use inside under the same or similar names.
CLASHING = ["id", "key", "fp", "node", "hash", "size", "shard", "score", "content", "digest", "keep", "label__", "n"]


@pytest.fixture(scope="session")
def tables(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """NULLs in every column, empty, blank and long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"word{k % 977} and" for k in range(30000))
    rows = [
        (1, "same text here for all"), (2, "same text here\nfor all"), (3, "same  text here for all"),
        (4, None), (5, ""), (6, " \n\t"), (7, "same text here for all"), (7, "same text here for all"),
        (None, "same text here for all"), (None, None), (8, long), (9, long + " "), (10, "other"), (10, "another"),
        (11, "Zażółć gęślą 日本語 😀   x"), (12, "a"),
    ]
    data = [(i, t, None if k % 3 else "en", None if k % 4 else "s", None if t is None else len(t), *[k] * len(CLASHING))
            for k, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
        f"`{c}` int" for c in CLASHING)
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def odd_labels(spark):
    rows = [(1, 1, 0), (8, 0, 1), (10, None, None), (None, 1, 1), (1, 1, 0), (12, 0, 1), (5, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
