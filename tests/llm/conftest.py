import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows, extra=True):
    """documents of (doc_id, text) or (doc_id, text, source); extra: with columns of names that operators use themselves."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if extra:
        for name in ("id", "key", "terms", "gone", "text_hash", "bands", "count", "uid", "h", "term", "item_id", "a.b", "__id"):
            df = df.withColumn(name, df.n_chars * 0)
    return df


def prose(seed, words=80, vocabulary=4000):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def odd_rows():
    """Nulls, empty and very long texts, repeated rows and ties."""
    return [
        (None, prose(1)),
        (None, None),
        (2, None),
        (3, ""),
        (4, "   \n\t "),
        (5, "?!"),
        (6, prose(6, 60_000)),
        (7, "word"),
        (8, prose(8)),
        (8, prose(8)),
        (8, prose(88)),
        (9, "éè \U0001f600 İstanbul ß"),
        (10, "x" * 200_000),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    return make(spark, odd_rows())


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
