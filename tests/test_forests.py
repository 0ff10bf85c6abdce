"""Spanning forests and trees of equal score, against all choices of heads."""

from fractions import Fraction
from itertools import product

import numpy as np

from lectern.functions import decoding
from lectern.operators.syntax import with_heads
from tests.test_odd_documents import same  # noqa: F401  (a fixture)

#: Numbers of documents whose matrix has two best forests in the query, and others.
TIED = (0, 447060, 796158, 1048572)


def forests(n):
    for heads in product(range(n), repeat=n):
        at = list(range(n))
        for _ in range(n):
            at = [heads[x] for x in at]
        if all(heads[x] == x for x in at):
            yield heads


def best(score, own=lambda heads: True):
    """The first of the best: `max` keeps the first it meets, and `product` counts upwards."""
    return max(filter(own, forests(len(score))), key=lambda heads: sum(Fraction(score[h][d]) for d, h in enumerate(heads)))


def matrices():
    r = np.random.default_rng(5)
    for n in (1, 2, 3, 4):
        for _ in range(60):
            yield r.integers(-1, 2, (n, n)).astype(float)
            yield r.choice([0.1, 0.2, 0.3, 1e-3, -0.7], (n, n))
            yield r.integers(-1, 2, (n, n)) * 2.0**70 + r.integers(0, 2, (n, n)) * 2.0**20


def test_first_of_the_best_forests():
    for score in matrices():
        assert tuple(decoding.first_forest(score).tolist()) == best(score.tolist()), score


def test_arcs_that_cannot_be():
    score = np.array([[0.0, 3, 3], [3, -np.inf, 3], [3, 3, -np.inf]])
    assert decoding.first_forest(score).tolist() == [0, 0, 0]


def test_heads_of_doubles_nulls_and_nothing(spark):
    close = [[1.0, 0.0], [0.0, 1.0]]
    close[1][0] = 1.0 + 1e-12  # the same as the root's score as a float
    rows = spark.createDataFrame([(0, close), (1, None), (2, []), (3, [[1.0, None], [0.0, 1.0]])], "i int, scores array<array<double>>")
    assert [x.heads for x in with_heads(rows).orderBy("i").select("heads").collect()] == [[1, 1], None, [], None]


def test_spanning_forests_that_tie(same):  # noqa: F811
    same("spanning_forests", [(i, "x") for i in TIED])


def test_first_of_the_best_trees():
    for score in matrices():
        n, cells = len(score), [x for row in score for x in row]
        heads = best(score.tolist())
        several = [d for d in range(n) if heads[d] == d]
        if len(several) > 1:
            keep = max(several, key=lambda d: score[d, d])
            dear = score.copy()
            for h, d in product(range(n), several):
                if not (d == keep if h == d else h in several):
                    dear[h, d] += min(cells) - max(cells)
            heads = best(dear.tolist())
            if sum(heads[d] == d for d in range(n)) > 1:
                heads = best(dear.tolist(), lambda x: all(x[d] != d or d == keep for d in range(n)))
        assert tuple(decoding.one_root(score, decoding.first_forest).tolist()) == heads, score


def test_spanning_trees_that_tie(same):  # noqa: F811
    same("spanning_trees", [(i, "x") for i in TIED])
