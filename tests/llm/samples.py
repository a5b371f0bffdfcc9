"""Small rows for the operators: nulls, empty and long texts, ties, repeats, clashing columns."""

import random
import re

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n_tokens string, score string, _t string, k int"


def awkward(spark, more=()):
    """Documents with every awkward case, and further columns named like the operators' own."""
    rng = random.Random(7)
    pool = ["alpha", "beta", "gamma", "the", "of", "delta", "Épsilon", "zeta9", "und", "漢字"]
    long_text = " ".join(rng.choice(pool) for _ in range(20_000))
    rows = [
        (1, None), (2, ""), (3, "   \n\t "), (4, "word"), (5, "the the the the the the"), (5, "the the the the the the"),
        (None, "a text without an id"), (None, None), (7, long_text), (8, "😀 " * 40), (9, "x" * 3000), (10, "!!! ??? ..."),
        *more,
    ]
    return spark.createDataFrame([(i, t, "en" if t else None, "n", "s", "t", 1) for i, t in rows], SCHEMA)


def empty(spark, schema=SCHEMA):
    return spark.createDataFrame([], schema)


def lower(text):
    """A-Z to a-z only."""
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def key(row):
    return tuple(str(v) for v in row) if isinstance(row, (tuple, list)) else (str(row),)


def ordered(rows):
    return sorted(key(r) for r in rows)
