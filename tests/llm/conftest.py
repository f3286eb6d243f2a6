import pytest

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(30_000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Rows with NULLs, empty and long texts, repeats, ties and columns of clashing names."""
    text = "The quick brown fox jumps over the lazy dog while seven wizards watch."
    rows = [(1, text, "en", "a", 70, "x", 1), (1, text, "en", "a", 70, "x", 1), (2, text.upper(), "en", None, 70, None, 2),
            (3, None, None, "a", None, "y", 3), (4, "", "en", "b", 0, "y", 4), (5, " \n\t ", "en", "b", 4, "y", 5),
            (None, "no id here", "en", "b", 10, "y", 6), (6, LONG, "en", "c", len(LONG), "y", 7),
            (7, "É\u2003x\x00y \U0001f600", "fr", "c", 6, "y", 8), (1, "another text of the same id", "en", "a", 27, "y", 9)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "score string, Size int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
