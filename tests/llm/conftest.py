import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra array<string>, word_count long, dc_hits string, fp string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table with extra columns, some named like columns that the operators add."""
    def make(rows):
        full = [(i, t, "en", s, None if t is None else len(t), ["x"], 1, "y", "z") for i, t, s in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and very long texts, ties and repeated rows, ids that repeat."""
    words = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    near = " ".join(f"t{i}" for i in range(600))
    return [
        (1, None, "a"), (2, "", None), (3, " \t\n", "b"), (None, "null id here", "a"), (None, "null id here", "a"), (4, words, "b"), (5, words, "b"),
        (6, near, "c"), (7, near + " more", "c"), (8, near, None), (8, near, None), (8, "another text of id eight", "c"),
        (9, "One two", "a"), (10, "one  TWO", "a"), (11, "Ünïcode ñ 𝒳 𝒴 \u0000 end", "d"), (12, "single", ""),
    ]
