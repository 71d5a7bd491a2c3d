import pytest

ODD_TEXTS = [
    None, "", " \n\t ", "one", "two words here", "the same line\n" * 6, "the same line\n" * 6, "é ü 東京 😀 " * 30, "x" * 50_000,
    ("alpha beta gamma delta " * 5 + "\n") * 3000, "a b c d e f g h i j\n\n\nk", "WORD!! " * 60, "%%% &&& " * 40, "\x0b\x0c\r a\x85b c",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts with nulls, repeated rows and names that operators might use themselves."""
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", len(t or ""), i, "x", True) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[3], rows[3], (None, "null id text", None, None, None, None, None, None)]
    names = "doc_id long, text string, lang string, source string, n_chars long, size long, _words string, kept boolean"
    return spark.createDataFrame(rows, names)
