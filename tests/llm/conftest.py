import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session", autouse=True)
def workers(spark):
    from dumpweave.llm.queries import workers_find_library

    workers_find_library(spark)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


LONG = " ".join(f"word{i % 97} thing{i % 89}" for i in range(3000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names operators use inside."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog " * 8, "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog " * 8, "en", "a"),
        (2, "The quick brown fox jumps over the lazy dog " * 8, "en", "a"),
        (3, None, None, None),
        (4, "", "de", "b"),
        (5, " \n\t ", "de", "b"),
        (6, "!!! 123 ???", None, "b"),
        (None, "Der schnelle braune Fuchs springt über den faulen Hund", "de", None),
        (None, None, None, None),
        (7, LONG, "en", "a"),
        (8, LONG + " tail", "en", "a"),
        (9, "çà et là 中文 😀 <|endoftext|> " * 5, "fr", "c"),
        (9, "another text with the same id as one before", "en", "c"),
    ]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = {c: F.lit(7) for c in ("n", "node", "label", "token", "key", "id", "term", "h", "c", "place", "spans")}
    return made.withColumns(clash)
