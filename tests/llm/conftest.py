import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """A frame of documents from texts; ids count from 0, with the source and further columns that clash with results."""

    def of(texts, ids=None, sources=None):
        ids = list(range(len(texts))) if ids is None else ids
        sources = ["s"] * len(texts) if sources is None else sources
        rows = [(i, t, "en", s, len(t) if t else 0, -1, "x") for i, t, s in zip(ids, texts, sources, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, size string")

    return of


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, short, repeated, tied, non-ASCII and very long texts."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    return [None, "", " \t\n", "a", "one two three four five", "one two three four five", "ÀÉÎ ß ẞ 漢字   \x1c x", "same word " * 400, long, long + " tail", "x" * 5000, "á b\n\n\nb\nb", "<|endoftext|> in text", "\U0001f600" * 50]
