"""Small tables that hold the cases every operator must take."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens string"


@pytest.fixture
def make_docs(spark):
    def make(texts, sources=None, langs=None, ids=None):
        ids = range(len(texts)) if ids is None else ids
        rows = [
            (i, t, (langs or ["en"] * len(texts))[n], (sources or ["s"] * len(texts))[n], len(t or ""), 0.5, "kept")
            for n, (i, t) in enumerate(zip(ids, texts, strict=True))
        ]
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture
def odd_texts():
    """Null, empty, blank, one word, ties, control and wide characters, a long word, a long text, special strings."""
    return [
        None, "", "   \n\t ", "word", "word", "Two words", "two  WORDS", "a\x1cb\x85c\xa0d e", "日本語のテキスト", "é̈ ñandú ß İ",
        "x" * 20_000, "word " * 20_000, "<|endoftext|>", "a<|endoftext|>b <|endoftext|> ", "it's we'll I'd'd", "1234 5²³¼", "tab\tnew\n\n\nlines \n x", "😀😀 emoji",
    ]
