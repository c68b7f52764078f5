from __future__ import annotations

import pytest

#: Null and empty texts, repeated rows, a very long text, copies, and columns with names that operators use themselves.
LONG = "lorem ipsum dolor " * 10_000


@pytest.fixture(scope="session")
def odd(spark):
    rows = [
        (1, "alpha beta gamma delta", "en", "src0", 1, "x", True, "a"), (2, None, "en", "src0", 0, None, None, None), (3, "", None, None, None, "y", False, ""), (4, "alpha beta gamma delta", "de", "other", 2, "z", True, "b"),
        (None, "no id here\nno id here", "de", "src1", 3, "x", None, "c"), (5, LONG, "en", "src2", len(LONG), "x", True, "d"), (6, "alpha beta gamma delta", "en", "src0", 1, "x", True, "a"), (6, "alpha beta gamma delta", "en", "src0", 1, "x", True, "a"),
        (7, " \t\n ", "fr", "src1", 4, "q", True, "e"), (8, "Grüße 😀 ß née", "de", "src3", 5, "q", False, "f"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint string, kept boolean, digest string")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (99, 1, 0), (None, 1, 0), (4, None, None)], "doc_id bigint, quality int, toxic int")
