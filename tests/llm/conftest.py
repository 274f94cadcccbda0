import pytest

TEXTS = [
    None,
    "",
    "...",
    "a",
    "The the of",
    "same text here and there",
    "same text here and there",
    "x" * 30_000,
    "word " * 9_000,
    "Ünïcödé 漢字 😀 text\nwith lines\r\n\tand tabs",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns whose names clash with outputs."""
    rows = [(i, t, ["en", None, "de"][i % 3], [None, "src0", "src1"][i % 3], None if t is None else len(t), "extra", i) for i, t in enumerate(TEXTS)]
    rows += [(5, TEXTS[5], "de", "src1", 24, "extra", 5), (5, TEXTS[5], "de", "src1", 24, "extra", 5), (None, "no id at all", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, rank int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
