import pytest


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, extra columns with clashing names."""
    long = " ".join(f"w{i * 7919 % 1009}x" for i in range(40_000))
    rows = [(1, None, "en", 1), (2, "", "en", 1), (3, " \n\t ", None, 2), (None, "a b c d e", "en", 2), (4, long, "en", None), (5, "x" * 200_000, "de", 1), (6, "same text here", "en", 1), (6, "same text here", "en", 1), (7, "<|endoftext|> Ä ß   z", "fr", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int").selectExpr("*", "'s' AS source", "1L AS n_chars", "0 AS score", "true AS held_out", "1 AS h", "2 AS component_id")


@pytest.fixture(scope="session")
def none(spark, docs):
    return docs.limit(0)
