import random

import pytest

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew strong tea and every cat sleeps near warm old stones".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="session")
def tricky(spark):
    """Documents with nulls, empty and very long texts, ties, repeats and near copies."""
    a, long = prose(1, 150), prose(2, 30_000)
    passage = prose(3, 60)
    rows = [
        (1, a, "en", "s1", 1), (2, a, "en", "s1", 1), (3, a.replace(" ", "\n"), "en", None, None), (4, prose(4, 40) + " " + passage + " " + prose(5, 40), "de", "s2", 1),
        (5, passage + " " + prose(6, 10), None, "s2", 1), (6, "", "en", "s3", 0), (7, None, "en", "s3", None), (8, " \t\n", None, None, 1), (9, long, "de", "é", 1), (10, "½ 123 ...", "en", "s1", 1),
        (11, "Ünïcode 日本語 text's end", "fr", "𝕊", 1), (None, a, "en", "s1", 1), (12, prose(12, 9), "fr", "s1", 1), (12, prose(12, 9), "fr", "s1", 1), (13, a + " extra", "en", "s2", 1), (14, passage + "\x85" + passage, "en", "s2", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
