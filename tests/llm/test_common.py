import random

from lectern.llm.common import components


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (200, 300), (300, 200), (200, 300)]
    low = {}
    for u, v in edges:
        low.setdefault(u, u)
        low.setdefault(v, v)
    for _ in edges:
        for u, v in edges:
            low[u] = low[v] = min(low[u], low[v])
    want = {(n, c) for n, c in low.items() if any(n in e and e[0] != e[1] for e in edges)}
    got = [tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
