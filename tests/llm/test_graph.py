import random

from wavemill.llm._graph import components


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(9)
    order = rng.sample(range(3000), 400)
    edges = [*zip(range(300), range(1, 301)), *zip(order[:200], order[1:201]), *((5000, 5001 + i) for i in range(300)), *((7000 + i, 7999) for i in range(300)), (1, 1), (None, 4), (9000, 9001), (9001, 9000)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
