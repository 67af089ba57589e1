import pytest

#: Names that operators use for columns of their own.
CLASHING = ("n", "node", "size", "rank", "bucket", "score", "label", "_size", "_source", "block", "path", "shard", "held_out")


def words(seed, n):
    return " ".join(f"w{(seed * 7919 + k * k * 31 + k) % 997}" for k in range(n))


ODD_TEXTS = [
    None, "", "   \n\t", "a", "a b c d", "one two three four five six", words(1, 300), words(1, 300),
    words(1, 299) + " changed", words(2, 60), "é漢字 😀 <|endoftext|> <s> \x00 tab\there\r\nnew  line", words(3, 30_000), "x" * 50_000,
    "same line\n" * 60, "go " * 200, " para nbsp　wide \x1c sep",
]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and very long texts, ties, repeated rows and extra columns with clashing names."""
    rows = [(k, t, "en", "s" if k % 3 else None, len(t or "")) for k, t in enumerate(ODD_TEXTS)]
    rows += [(6, ODD_TEXTS[6], "en", "s", 1), (6, ODD_TEXTS[6], "en", "s", 1), (None, ODD_TEXTS[6], None, None, None), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, name in enumerate(CLASHING):
        frame = frame.selectExpr("*", f"{k} AS `{name}`")
    return frame


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")
