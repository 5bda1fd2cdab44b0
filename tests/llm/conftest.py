"""Frames that every operator has to bear."""

import random

import pytest

from tallyhouse.llm.common import prepare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def llm(spark):
    prepare(spark)
    return spark


@pytest.fixture(scope="session")
def odd(llm):
    """Null and repeated ids, null, empty, blank, repeated and very long texts, and columns with clashing names."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    long = " ".join(word() for _ in range(60_000))
    texts = [None, "", "   \n", "a b c", "a b c", "Éa déjà vu 漢字 \U0001f600 " * 5, long, "x" * 300_000, 'token = "abcdef123456"', "\x00\x1c▁ b"]
    rows = [(i, t, "en", "s", len(t or ""), "id", "word", 1) for i, t in enumerate(texts)] + [(None, "no id here", None, None, None, None, None, None), (3, "a b c", "en", "s", 5, "x", "y", 2)]
    return llm.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, word string, row int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
