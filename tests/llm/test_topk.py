import math
import random

import numpy as np
import pytest

from shelfwise.llm import topk

SCHEMA = "vec_id long, embedding array<double>, score int, shard string"


def brute(rows, asked, k):
    fit = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in fit if asked(i)}):
        v = min(u for i, u in fit if i == q)
        best = sorted((-sum(a * b for a, b in zip(u, v)), i) for i, u in fit if i != q and len(u) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def run(spark, rows, asked, k=5):
    d = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in topk.search(d, d.where(asked), k).collect())


@pytest.mark.parametrize("sizes", [{}, {"SHARD": 40, "LEAF": 4, "BLOCK": 3, "GROUP": 1, "CHUNK": 1, "HELD": 1}])
def test_search_equals_brute_force(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(4)
    rows = [(i, [round(rng.uniform(-1, 1), 1) for _ in range(rng.choice([2, 2, 2, 5]))]) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(20)]  # ties
    rows += [(500, None), (501, []), (502, [0.1, None]), (503, [math.nan, 0.1]), (504, [math.inf, 0.1]), (None, [0.1, 0.2]), (510, [1.5]), (520, [0.0, 0.0])]
    assert run(spark, rows, "vec_id % 10 = 0") == brute(rows, lambda i: i % 10 == 0, 5)
    assert run(spark, rows[:3], "vec_id >= 0", 2) == brute(rows[:3], lambda i: True, 2)


def test_search_of_nothing(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert topk.search(d, d).count() == 0
    one = spark.createDataFrame([(1, [0.5], 1, "x")], SCHEMA)
    assert topk.search(one, one).count() == 0 and topk.search(one, d).count() == 0


def test_large_scores_are_exact_or_an_error(spark):
    rows = [(1, [3e6, 1.0]), (2, [3e6, 2.0]), (3, [3e6, 3.0]), (4, [-3e6, 0.5])]
    assert run(spark, rows, "vec_id > 0") == brute(rows, lambda i: True, 5)
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(1, [1e12]), (2, [1e12])], "vec_id > 0")


def test_tree_boxes_hold_their_rows():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(0, 100, (1000, 6)))
    tree = topk.Tree.build(np.arange(1000), x)
    again = topk.Tree.unpacked(6, list(tree.packed()))
    assert (again.x == tree.x).all() and (again.ids == tree.ids).all()

    def rows(node):
        if tree.left[node] < 0:
            return list(range(tree.start[node], tree.stop[node]))
        return rows(tree.left[node]) + rows(tree.left[node] + 1)

    assert sorted(tree.ids[rows(0)]) == list(range(1000))
    for node in range(len(tree.left)):
        held = tree.x[rows(node)]
        assert (held.min(axis=0) == tree.low[node]).all() and (held.max(axis=0) == tree.high[node]).all()
