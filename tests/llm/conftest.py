import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component long, h string, key string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of given texts, with columns whose names clash with those that operators use inside."""

    def make(texts, first=0):
        rows = [(first + i, t, "en" if i % 3 else None, f"s{i % 2}", len(t or ""), 7, "x", None) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA).repartition(3)

    return make


@pytest.fixture(scope="session")
def prose():
    def make(n, seed=0, words=400):
        r = random.Random(seed)
        vocab = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(words)]
        return " ".join(r.choice(vocab) for _ in range(n))

    return make


ODD = [None, "", " \n\t ", "one", "one two", "a" * 20_000, "word " * 3000, "é\x00 \x1c tab\tx", "same same same same same same same same same same same same"]


@pytest.fixture(scope="session")
def odd():
    return ODD
