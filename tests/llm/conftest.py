import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def stored(spark, sf):
    """(doc_id, text) of the test table."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return sorted((r[0], r[1]) for r in rows)


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from rows of (doc_id, text)."""
    return lambda rows: spark.createDataFrame(rows, "doc_id long, text string")


EDGES = [
    (None, "no id at all"),
    (None, None),
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "the of and"),
    (6, "same text twice " * 20),
    (7, "same text twice " * 20),
    (7, "another text under the same id " * 9),
    (7, "another text under the same id " * 9),
    (8, "é" * 400),
    (9, "x" * 300_000),
    (10, "word " * 60_000),
    (11, "123 456 $$$"),
    ((1 << 62) + 1, "a very large id, which a double cannot hold"),
]


@pytest.fixture
def edges():
    return list(EDGES)


@pytest.fixture
def passages():
    """Documents with near copies, and passages that many share."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeghilmnoprst") for _ in range(rng.randint(1, 8)))
    shared = " ".join(word() for _ in range(120))
    rows = []
    for _ in range(30):
        words = [word() for _ in range(rng.randint(30, 200))]
        for copy in range(rng.choice((1, 1, 2, 6))):
            text = list(words)
            for _ in range(copy * 2):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.5:
                at = rng.randrange(len(shared) - 150)
                text.insert(rng.randrange(len(text)), shared[at : at + rng.randint(60, 400)])
            rows.append((len(rows) * 3 + 1, " ".join(text)))
    return rows
