import random

import pytest

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels")
#: A column that no operator may trip over: names that operators use themselves.
EXTRA = ("part", "shard", "score", "fp", "n", "k", "row", "bucket", "component_id")


@pytest.fixture(scope="session")
def words():
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(4000)]


@pytest.fixture(scope="session")
def odd_docs(spark, words):
    """Null ids and texts, empty, blank, short and very long texts, ties, repeated rows, extra columns."""
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, long = text(60), text(30_000)
    swapped = base.split()
    swapped[30] = "other"
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "a b c d"), (7, "a b c d e"), (8, base), (9, base.upper()),
        (10, " ".join(swapped)), (11, long), (12, long + " tail"), (13, base), (13, base), (14, text(40)), (None, base), (None, None),
        (15, "été Über straße 中文 字 " * 3), (16, " ".join("abcdef")), (17, "x" * 200_000),
    ]
    rows = [(i, t, "en", None if k % 5 == 0 else "src0", None, *([k] * len(EXTRA))) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in EXTRA))
