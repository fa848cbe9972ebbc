import random

from driftspark.llm.graph import components


def test_components_of_chains_stars_and_nothing(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 130)] + [(7, i) for i in range(8, 20)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)]
    root = {x: x for e in edges for x in e}

    def top(x):
        return x if root[x] == x else top(root[x])

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    got = {row.node: row.root for row in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in root if top(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
