import random

import pytest

WORD = "the of and to in a is that der die le la de el que".split()


@pytest.fixture(scope="session")
def corpus(spark):
    """Small documents with copies, near copies, shared passages and every edge case."""
    rng = random.Random(5)

    def text(n):
        return " ".join(rng.choice(WORD) if rng.random() < 0.3 else "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 3))) for _ in range(n))

    rows, passage, base = [], text(80), text(200)
    for i in range(60):
        rows.append((i, text(rng.randint(1, 150)), rng.choice(["en", "de"]), f"s{i % 4}"))
    for i in range(60, 80):
        words = base.split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "en", "hot"))
    for i in range(80, 100):
        rows.append((i, f"{text(rng.randint(0, 30))} {passage} {text(rng.randint(0, 30))}", "fr", "hot"))
    rows += [(100, None, "en", "s1"), (101, "", None, None), (102, "   \n\t ", "en", None), (103, "a", "en", "s1"), (104, "!!! ???", "en", "s1"), (105, base, "en", "hot"), (105, base, "en", "hot"), (None, base, "en", "hot"),
             (106, "x " * 4000, "en", "s2"), (107, "é" * 3000, "fr", "s2"), (108, text(9000), "en", "s2"), (109, "one two three four", "en", "s3"), (110, "one two three four", "en", "s3")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(corpus):
    return corpus.limit(0)
