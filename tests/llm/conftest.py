import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, size long, target double, kept boolean, key string, c long, n long, found string, host string, tokens string, perplexity double, row string, label long, v long, bin_id long, `spans` string"


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text[, lang, source]) as a documents table."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA)
    return make


@pytest.fixture
def awkward(spark):
    """Nulls in any column, empty and long texts, repeated rows, and columns whose names clash."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    text = " ".join(words[:80])
    rows = [(1, text, "en", "a"), (2, None, None, None), (3, "", "de", "b"), (4, text, None, "a"), (5, long, "en", None), (5, long, "en", None), (None, "null id text", "en", "a"), (6, " \t\n", "fr", "c"), (7, "one", "fr", "c"), (7, "another text", "fr", "c")]
    full = [(*r, None, 1, 1.0, None, "k", 2, 3, None, "h", None, None, "r", 1, 2, 3, None) for r in rows]
    return spark.createDataFrame(full, AWKWARD)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
