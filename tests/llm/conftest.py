import pytest

ODD_TEXTS = [
    None,
    "",
    " \t\n ",
    "one",
    "Four little words here",
    "five words are just enough",
    "Tab\tand\x0bvertical\x0c tab\r\nline",
    "ÀÉ Ñ ß İstanbul 　 wide space ŷ",
    "  leading  and   double   blanks  ",
    "!!! ??? ... ### $$$ %%% &&& | <> ***",
    "same same same same same same same same same same",
    "line\nline\nline\n\nother\nline",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts, repeated rows, ties and extra columns with clashing names."""
    rows = [(i, t, "x", i, 1.0, 7) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[4], rows[5], (90, ODD_TEXTS[5], "y", 0, 0.0, 0), (91, "word " * 30000, "y", 0, 0.0, 0)]
    schema = "doc_id long, text string, lang string, n int, score double, place int"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
