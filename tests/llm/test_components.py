"""Connected components against a plain version."""

import random

import pytest

from loomlog.llm.components import components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent if find(x) != x}


@pytest.mark.parametrize("n, m", [(40, 30), (60, 200), (1, 0)])
def test_random_graphs(spark, n, m):
    rng = random.Random(n)
    edges = [(rng.randrange(n) - n // 2, rng.randrange(n) - n // 2) for _ in range(m)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == brute(edges)


def test_path_and_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 200)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == brute(edges)
