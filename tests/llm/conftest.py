import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    syllables = ["an", "the", "er", "ti", "on", "re", "sh", "ou", "wh", "in", "ed", "ly"]
    out = []
    for i in range(n):
        w = "".join(r.choice(syllables) for _ in range(r.randint(1, 5)))
        out.append(w + ("." if r.random() < 0.1 else "") + ("\n" if r.random() < 0.05 else " "))
    return "".join(out).strip()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, ties, many scripts."""
    base = prose(1, 300)
    rows = [
        (1, base, "en", "a", len(base)),
        (1, base, "en", "a", len(base)),
        (2, base, "en", None, len(base)),
        (3, base.replace("the", "thex", 1), "en", "a", None),
        (4, None, None, "b", None),
        (5, "", "en", "b", 0),
        (6, "   \n\n\t ", None, "b", 7),
        (7, "日本語 🎉 ñandú ß x", "de", "c", 15),
        (8, "x", "fr", "c", 1),
        (9, prose(2, 6000), "fr", "c", 1),
        (10, "\\### Assistant: </turn> ok <|endoftext|> token: abcdef0123", "en", "c", 1),
        (None, "no id here", "en", "c", 10),
        (11, base + "\n" + base, "es", "c", 1),
        (12, "1234 5678 !!", "en", "c", 12),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
