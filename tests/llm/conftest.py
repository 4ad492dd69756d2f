"""Tables that every corpus operator must bear."""

import pytest

WORDS = "river stone lamp paper glass cloud bread horse table green seven north quiet metal sugar plant".split()


@pytest.fixture(scope="session")
def hard_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    body = " ".join(f"{WORDS[i % 16]}{i // 16}" for i in range(120))
    rows = [
        (1, body, "en", "a", 100, "x", 0.5, True),
        (1, body, "en", "a", 100, "x", 0.5, True),
        (2, body, "en", "b", 100, None, None, None),
        (3, body + " tail", "en", None, None, "y", 1.0, False),
        (4, "", "en", "a", 0, None, None, None),
        (5, None, "en", "a", None, None, None, None),
        (None, body, "en", "a", 100, None, None, None),
        (None, None, None, None, None, None, None, None),
        (6, "der Hund und die Katze sind auf dem Dach und schlafen in der Sonne", "de", "b", 66, None, None, None),
        (7, "!!! ??? ...", None, "b", 11, None, None, None),
        (8, ("long text without end " * 60_000) + "\U0001f600 ünïcode", "en", "a", 1_320_010, None, None, None),
        (9, "tie one", "en", "a", 7, None, None, None),
        (10, "tie two", "en", "a", 7, None, None, None),
    ]
    # names that the operators use for themselves
    schema = "doc_id long, text string, lang string, source string, n_chars long, bucket string, score double, keep boolean"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def empty_docs(hard_docs):
    return hard_docs.limit(0)
