from __future__ import annotations

import random

import pytest

LETTERS = "abcdefghijklmnop"
ODD_TEXTS = (None, "", " ", "\n\t ", "a", "!!! ###", "<|endoftext|> <|im_end|>", "é" * 40, "x" * 5000, "A a A a\x1c b")


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(2, 8))) for _ in range(400)]


@pytest.fixture()
def prose(words):
    """Function of a seed and a number of words."""

    def make(seed: int, n: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))

    return make


DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def documents(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, l, s, len(t) if t is not None else None) for i, t, l, s in rows], DOCUMENT)

    return make
