from __future__ import annotations

import pytest

LONG = " ".join(f"w{i % 7919}x" for i in range(40_000))


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Documents with every awkward case, and further columns named like the operators' own."""
    rows = [
        (None, "nobody knows which document this text belongs to at all", "en"),
        (1, None, "en"),
        (2, "", None),
        (3, " \t\n ", "fr"),
        (4, LONG, "en"),
        (5, "the same words in the same order stand here two times over", "en"),
        (5, "the same words in the same order stand here two times over", "en"),
        (6, "The same words in the SAME order stand here two times over", "en"),
        (7, "one", None),
        (7, "another text under a number that was given out before", "en"),
        (8, "12345 67890 !!! ??? ...", "de"),
        (9, "Ünïcödé ﬁ Å ΣΑΣ 日本語 👍🏽 ​<|endoftext|> tail", "de"),
    ]
    data = [(d, t, x, "s", 0.5, 7, [1], "k") for d, t, x in rows]
    return spark.createDataFrame(
        data, "doc_id long, text string, lang string, source string, score double, shard int, ids array<int>, hash string"
    )


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
