import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and blank texts, ties, repeated rows, odd characters, a long text, extra columns."""
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
    texts = [
        None, "", " \t\n ", "one", "one", "a b c d e f", "A b c D e f", "line one is long enough here\nshort\nline one is long enough here",
        "  LINE one is long enough here \nother", "line ONE is long enough here", "été   x\x1cy\x85z", "日本 語", "it's 's <|endoftext|> 12 3.4", long, long + " tail", "\n\n\n", "12 34 !!",
    ]
    rows = [(i, t, ["en", "fr", None][i % 3], f"s{i % 2}", i, "x", 1) for i, t in enumerate(texts)]
    rows += [rows[5], rows[7]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept_text string, _id int")
