from __future__ import annotations

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def long_text(words: int = 30_000) -> str:
    return " ".join(f"w{i * 7919 % 5003}" for i in range(words))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns named like results."""
    rows = [
        (1, "The cat sat on the mat and the dog ran to the park", "en", "a", 50),
        (1, "The cat sat on the mat and the dog ran to the park", "en", "a", 50),
        (2, None, None, None, None),
        (3, "", "en", None, 0),
        (4, long_text(), "en", "b", 1),
        (5, "the été \U0001f600\U0001f600 password = \"hunter2hunter2\" \x0b tail", "fr", "b", 1),
        (None, "no id here", "en", "a", 10),
        (6, " \t\n ", "en", "c", 4),
    ]
    extra = "fingerprint int, score string, component_id int, size string, spans int, position int, piece int"
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3, 4, 5) for r in rows], f"{DOCUMENTS}, {extra}")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
