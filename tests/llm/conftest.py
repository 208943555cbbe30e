import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, copies, near copies, repeated rows, and columns with names that operators make."""
    rows = [
        (1, PASSAGE, "en", "a", 1), (2, PASSAGE.upper(), "en", "a", 1), (3, PASSAGE + " more", "en", "b", 1), (4, "", "en", "a", 0), (5, None, None, None, None),
        (6, "  \t\n ", "en", "a", 5), (7, LONG, "en", "b", 1), (8, LONG + " end", "de", None, 1), (9, "short one", "fr", "c", 1), (9, "short one", "fr", "c", 1),
        (None, "no id here", "en", "a", 1), (11, "É é ß Straße 中文 😀", "de", "c", 1), (12, "SHORT ONE", "fr", "c", 1), (13, "a b c d e f g", "en", "a", 1), (14, "A B C D E F G", "en", "a", 1),
    ]
    names = ["kept", "score", "shard", "SLOT", "entity", "token_ids", "n_tokens", "block", "keep_id", "__text"]
    wide = [(*r, *(["x"] * len(names))) for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)).repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
