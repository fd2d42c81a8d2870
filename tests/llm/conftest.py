import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, found string, score double, key string"


def rows_of(texts, sources=None, ids=None):
    """Documents, with extra columns whose names clash with those that operators make."""
    return [(i if ids is None else ids[i], t, "en", sources[i] if sources else f"s{i % 3}", None if t is None else len(t), "x", 0.5, "k") for i, t in enumerate(texts)]


@pytest.fixture
def docs(spark):
    def make(texts, sources=None, ids=None):
        return spark.createDataFrame(rows_of(texts, sources, ids), DOCS)

    return make


@pytest.fixture
def odd(docs):
    """Nulls in every column, empty and blank texts, repeated rows, ties, a long text."""
    long = " ".join(random.Random(5).choice(["alpha", "beta", "gamma", "delta"]) + str(i % 50) for i in range(40_000))
    texts = [None, "", " \t\n", "one", "same words here again", "same words here again", "héllo wörld ünïcode 漢字 \U0001f600", long, "x" * 5000, "a\n\nb\n"]
    sources = ["a", None, "a", "b", "b", "b", None, "a", "c", "c"]
    ids = [0, 1, None, 3, 4, 4, 6, 7, 8, 9]
    return docs(texts, sources, ids)


@pytest.fixture
def empty(docs):
    return docs([])
