import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, key int, id string, size int, start int, block int, _key int, _row int, _score int, score string, _text string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{rng.choice('abcdefgh')}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty and blank texts, repeated rows, ties, a very long text, near copies and shared passages."""
    rng = random.Random(3)
    base, passage = words(rng, 120), words(rng, 60)
    near = base.split()
    near[60] = "changed"
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t "), (None, "one"), (None, None), (7, "one"),
        (8, words(rng, 40) + " " + passage + "\n" + words(rng, 30)), (9, words(rng, 70) + "\n" + passage + " " + words(rng, 5)),
        (10, words(rng, 60_000, 10**6)), (11, "x" * 300_000), (12, "a a a a a a a a a a a a"), (13, "É é 日本 語   token = \"AAAA1111bbbb2222\"  x"),
        (14, "l1 same line here\nl1 same line here\n\n\nl1 same line here"), (15, words(rng, 9)), (16, words(rng, 10)),
    ]
    return [(k, t, "en" if k != 7 else None, f"s{(k or 0) % 3}" if k != 5 else None, len(t or ""), "r", 1, "i", 2, 3, 4, 5, 6, 7, "s", "t") for k, t in texts]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
