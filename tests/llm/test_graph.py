import random

import numpy as np
import pytest

from lakewright.llm.graph import connected_components, least_reached


def brute(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = root(a), root(b)
        parent[max(p, q)] = min(p, q)
    return {x: root(x) for x in parent}


def cases():
    rng = random.Random(3)
    yield [(i, i + 1) for i in range(40)]
    yield [(0, i) for i in range(1, 200)]
    yield [(7, 3), (3, 7), (7, 7), (7, 3), (-5, 9), (9, 2**40)]
    yield [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)]
    yield [(i, i // 2) for i in range(1, 100)]


@pytest.mark.parametrize("edges", list(cases()))
def test_components(spark, edges):
    df = spark.createDataFrame([*edges, (None, 1), (1, None)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {x: c for x, c in brute([e for e in edges if e[0] != e[1]]).items()}
    ids = np.array(sorted({x for e in edges for x in e})[::-1])
    at = {int(x): k for k, x in enumerate(ids)}
    local = least_reached(ids, np.array([at[a] for a, _ in edges]), np.array([at[b] for _, b in edges]))
    assert {int(x): int(c) for x, c in zip(ids, local, strict=True)} == brute(edges)


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
