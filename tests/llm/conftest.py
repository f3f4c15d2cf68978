import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tie string, label int, hash long, size long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    long = " ".join(f"word{k % 977} the of" for k in range(4000))
    rows = [
        (1, "The quick fox of the hill and the river is in a valley to see it for that was on the way", "en", "a", 5, "x", 1, 2, 3),
        (2, None, None, None, None, None, None, None, None), (3, "", "en", "a", 0, "x", 1, 2, 3), (4, long, "de", "b", 9, "x", 1, 2, 3), (4, long, "de", "b", 9, "x", 1, 2, 3),
        (5, "x" * 9000, "fr", None, 9, "x", 1, 2, 3), (None, "password=hunter22 and a token: abcdefgh", "en", "a", 1, "x", 1, 2, 3), (7, " \n\t \x0b", "es", "c", 1, "x", 1, 2, 3),
        (8, "one two\none two\nthree\n\none two", "en", "a", 1, "x", 1, 2, 3), (9, "ÜBER straße ŒUVRE 日本語 🙂 é", "de", "b", 1, "x", 1, 2, 3),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
