"""Small tables with the odd rows that every operator must take."""

from __future__ import annotations

import random

WORDS = "the of and a to in that it was for on are with as his they be at one have".split()
LONG = " ".join(WORDS[i * 7 % 20] + str(i) for i in range(60_000))


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice("aeiou") + rng.choice(WORDS) for _ in range(n))


def odd_docs(spark, texts=()):
    """doc_id, text and columns whose names clash with results; NULLs, blanks, repeats, a long text."""
    rows = [
        (1, "One line here.\nAnother line there.", "en", 0.5),
        (2, None, None, None),
        (3, "", "", 0.0),
        (4, " \n\t\n ", "fr", 1.0),
        (None, "One line here.\nAnother line there.", "en", 0.5),
        (5, LONG, "en", 0.1),
        (6, "123 456 !!!", "en", 0.1),
        (1, "One line here.\nAnother line there.", "en", 0.5),
        *((100 + i, t, "en", 0.2) for i, t in enumerate(texts)),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    for clash in ("n", "id", "key", "kept", "component_id", "removed_lines", "secrets", "leaks"):
        frame = frame.selectExpr("*", f"'x' AS {clash}")
    return frame


def empty_docs(spark):
    return odd_docs(spark).limit(0)
