"""Fixtures for the training-data operators."""

from __future__ import annotations

import random

import pytest

from lodestone.llm.common import worker_path

SYLLABLES = ["ba", "re", "tin", "ol", "da", "mu", "ser", "ko", "li", "an", "the", "no"]


@pytest.fixture(scope="session", autouse=True)
def _workers(spark):  # noqa: ANN001, ANN202
    worker_path(spark)


@pytest.fixture
def words():  # noqa: ANN201
    """A function that makes n invented words, the same for the same seed."""

    def make(n: int, seed: int = 0) -> list[str]:
        r = random.Random(seed)
        return ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n)]

    return make


@pytest.fixture
def docs_of(spark):  # noqa: ANN001, ANN201
    """A documents table from (doc_id, text) pairs, with columns whose names clash with inner ones."""

    def make(rows: list[tuple]):  # noqa: ANN202
        return spark.createDataFrame([(i, t, "en", "s", None, "x", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id string, k int")

    return make
