import pytest

TEXTS = [
    None, "", " ", "a  b", "one two\n\nthree   four ", "x<|endoftext|> y", "don't I'll", "ééé  über　字 x",
    "a b c d e f g", "a b c d e f g", "word " * 3000, "z" * 9000, "\x1c a\x1c b", "😀 x😀", "ΣΑΣ Å İ",
]


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty, repeated and long texts, extra columns with names the operators use inside."""
    rows = [(i, t, None if i % 3 else "en", "s", 7, "x", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, _rank string, length int"
    ).repartition(3)


@pytest.fixture
def no_docs(odd_docs):
    return odd_docs.where("doc_id < 0")
