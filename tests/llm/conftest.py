from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    r = random.Random(5)
    return ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, source="s", start=0, extra=False):
        rows = [(start + i, t, "en", source if isinstance(source, str) else source(i), len(t or "")) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, DOCS)
        return df.selectExpr("*", "'x' as `row`", "1 as digest", "2 as size", "3 as n") if extra else df

    return make


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
