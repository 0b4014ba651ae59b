import random

from findrift.llm.graph import components


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 5000), (None, 3), (-7, 2000), (2000, -7)]
    edges += [(rng.randint(3000, 3200), rng.randint(3000, 3200)) for _ in range(120)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in up}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0
