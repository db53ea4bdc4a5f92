"""Connected components against a union-find."""

import random

import pytest

from tallyground.operators import components
from tallyground.operators.components import connected_components


def roots(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in list(parent) if find(x) != x)


@pytest.mark.parametrize("one_task", [1_000_000, 40, 0])
@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed, one_task, monkeypatch):
    """In one task; by rounds that end in one task; by rounds alone."""
    monkeypatch.setattr(components, "ONE_TASK", one_task)
    rng = random.Random(seed)
    names = rng.sample(range(1000), 300)
    paths = [(names[i], names[i + 1]) for i in range(200) if i % 50]
    edges = paths + [(rng.choice(names), rng.choice(names)) for _ in range(40)] + [(names[250], n) for n in names[251:]]
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted((r.u, r.root) for r in got) == roots(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([(3, 3)], "u long, v long")).isEmpty()
