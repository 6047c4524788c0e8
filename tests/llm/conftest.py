import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, n int, row string, least int, family long, kept string, __id int"


def documents(spark, rows):
    """A documents table with further columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), 1, 2, "r", 3, 4, "x", 5) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda rows: documents(spark, rows)


def invented(seed, words=400, vocabulary=900):
    """Invented prose that no other seed repeats."""
    r = random.Random(seed)
    return " ".join("".join(r.choice(["an", "the", "or", "is", "en", "ly", "re", "ou"]) for _ in range(r.randint(1, 4))) + str(r.randint(0, vocabulary)) for _ in range(words))


@pytest.fixture(scope="session")
def prose():
    return invented
