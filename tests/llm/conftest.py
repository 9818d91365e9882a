import pytest

from popmeasure.llm.common import ship


@pytest.fixture(autouse=True, scope="session")
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns that clash with the operators' own names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again.", "en", "a", "x"),
        (2, "the quick brown fox jumps over the lazy dog again and again.", "en", "a", "y"),
        (2, "the quick brown fox jumps over the lazy dog again and again.", "en", "a", "y"),
        (3, None, None, None, None),
        (4, "", "en", "b", "z"),
        (5, " \t\n ", "en", "b", "z"),
        (6, "é " * 40_000, "fr", "b", "z"),
        (None, "Completely different words stand here, one after the other.", "en", None, "x"),
        (None, "Completely different words stand here, one after the other.", "en", None, "x"),
        (9, "x", None, "c", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, words string, hits string")
