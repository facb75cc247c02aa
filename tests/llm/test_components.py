from __future__ import annotations

import random

import pytest

from lodestone.llm.components import components


@pytest.mark.parametrize("kind", ["path", "random", "star", "none"])
def test_components(spark, kind):  # noqa: ANN001
    r = random.Random(1)
    links = {"path": [(i, i + 1) for i in range(20)], "random": [(r.randrange(60), r.randrange(60)) for _ in range(40)], "star": [(0, i) for i in range(1, 20)], "none": []}[kind]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = dict(map(tuple, components(spark.createDataFrame(links, "a int, b int")).collect()))
    assert got == {x: root(x) for x in parent}
