from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, lost string, n long, positive string, copies int, node string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls everywhere, empty and long texts, repeated rows, and columns named like the operators' own."""
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "Epsilon", "zeta,", "été", "x"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [prose(60) for _ in range(12)] + [None, "", "   \n\t", "one", "\n\n", "!!! 123", prose(60_000), "日本語 テキスト"]
    rows = [(k, t, ["en", "fr", None][k % 3], ["s1", "s2", None][k % 3], 0, 1.0, "l", 7, "p", 3, "n") for k, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, texts[1], None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
