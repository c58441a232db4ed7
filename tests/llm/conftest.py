import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, row string, key string, score double"


@pytest.fixture(scope="session")
def docs(spark):
    """Odd rows: null and empty texts, repeated rows, ties, no id, one very long word, columns of clashing names."""
    words = "the quick brown fox jumps over the lazy dog while seven wizards box with five quiet judges and".split()
    base = " ".join(words * 4)
    near = base.replace("wizards", "wizard", 1)
    texts = {
        1: base + "\nshared line of a few words",
        2: base + "\nshared line of a few words",
        3: near + "\nshared line of a few words",
        4: None,
        5: "",
        6: " \n\t ",
        7: "x" * 200_000,
        8: "a@b.co 10.0.0.1 +1 (269) 555-3296 4111111111111111 four",
        9: "one two three",
        10: "ONE two  three",
        11: "über straße ▁ 東京 " * 30,
        12: "shared line of a few words\nshared line of a few words\r\nother text here now",
    }
    rows = [(i, t, "en" if i % 2 else "de", "s", 0, i, 1, "r", "k", 0.5) for i, t in texts.items()]
    rows += [rows[8], (None, "no id at all", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
