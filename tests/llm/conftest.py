import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, tag string, key string"


@pytest.fixture
def docs(spark):
    """Rows with nulls in every column, empty and long texts, ties, repeats, and extra columns with clashing names."""
    long = " ".join(f"word{i % 977} and more" for i in range(9000))
    base = " ".join(f"some words {i} of a plain document" for i in range(40))
    rows = [
        (1, base, "en", "src1", 1, "a", "b", "c"), (2, base, "en", "src1", 1, None, None, None), (3, base.replace("words 7 ", "words seven "), "en", "src2", 1, "", "", ""),
        (4, "", "de", "src2", 0, "x", "y", "z"), (5, None, None, None, None, None, None, None), (6, " \t\n ", "de", None, 3, "1", "2", "3"), (7, long, "fr", "src3", 9, "l", "m", "n"),
        (8, "Straße — naïve 𠀀 text 🙂 " * 6, "de", "src4", 2, "p", "q", "r"), (None, "a row without a key but with a text " * 5, "en", "src1", 2, "u", "v", "w"), (8, "Straße — naïve 𠀀 text 🙂 " * 6, "de", "src4", 2, "p", "q", "r"),
        (10, "short", "es", "src5", 5, "s", "t", "u"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)
