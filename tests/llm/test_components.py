import random

import pytest
from folioscope.llm import components as c


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(c, "SMALL", small)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(50)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(5, 5), (7, 3)]
    rng.shuffle(edges)
    root: dict[int, int] = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in edges:
        if a != b:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    got = c.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in root)
    assert c.components(spark.createDataFrame([], "u long, v long")).count() == 0
