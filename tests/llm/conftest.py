import random

import pytest

CLASHES = ("id", "n_words", "size", "host", "score", "f", "key", "words", "h", "t", "w", "v", "fp", "u", "line", "source_size", "target", "file", "block", "rule", "path", "verdict", "n", "p", "item", "kept", "place", "y", "c")


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgéñ") for _ in range(r.randint(2, 8))) for _ in range(n))


def nasty_rows():
    """(doc_id, text, source): nulls, empty, blank and very long texts, repeated rows, copies."""
    r = random.Random(3)
    a, b = prose(r, 60), prose(r, 40)
    rows = [(1, a, "s1"), (2, a, "s1"), (2, a, "s1"), (3, b, "s2"), (4, None, "s2"), (5, "", None), (None, b, "s1"), (6, " \n\t ", "s1"), (7, "one two", None), (8, a.replace(" ", "\n"), "s3")]
    rows += [(9, prose(r, 20000), "s1"), (10, "x " * 5000, "s2"), (11, b + "\n" + b + "\n" + a, "s1"), (12, None, None)]
    return rows


@pytest.fixture(scope="session")
def nasty(spark):
    """A frame of the nasty rows with further columns whose names clash with those that operators use."""
    rows = [(i, t, "en", s, len(t or ""), *["z"] * len(CLASHES)) for i, t, s in nasty_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)).repartition(3).cache()
