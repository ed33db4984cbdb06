"""Search against all products."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import topk as t


def plain(rows, k):
    vectors = {i: v for i, v in rows if i is not None and v is not None}
    out = []
    for q in vectors:
        if q % 5 == 0:
            found = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed,size", [(0, 20), (1, 20), (2, 1 << 28)])
def test_same_as_all_products(spark, seed, size):
    r = random.Random(seed)
    rows = [(i, [r.randint(-size, size) for _ in range(6)]) for i in range(240)]
    rows += [(i, [3, 3, 3, 3, 3, 3]) for i in range(240, 330)] + [(500, [1, 2]), (505, [2, 2]), (510, None), (None, [1] * 6)]
    frame = spark.createDataFrame(rows + rows[:9], "vec_id long, v array<long>")
    got = t.top_k(frame, frame.filter("vec_id % 5 = 0"), k=4, shard_rows=60, block_rows=17)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == plain(rows, 4)


def test_bounds_and_exact_big_integers():
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (500, 5)).astype(float)
    tree, q = t.BoxTree(x), rng.integers(-50, 50, (7, 5)).astype(float)
    b = tree.bounds(q)
    for node, (s, e) in enumerate(tree.span):
        assert (q @ x[tree.order[s:e]].T <= b[:, [node]]).all()
    big = np.array([[1 << 30, 1], [1 << 30, 2], [0, 1]], dtype=np.int64)
    assert t.search(big, np.arange(3), big[:1], np.array([9]), np.array([-np.inf]), 2) == [(9, 1, (1 << 60) + 2), (9, 0, (1 << 60) + 1)]


def test_odd_vectors_and_empty_table(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.001]), (1, [nan, 1.0]), (2, [inf, 1.0]), (3, None), (4, [None, 1.0]), (5, [1.0, 1.0]), (None, [1.0, 1.0]), (5, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = frame.select("vec_id", t.scaled(F.col("embedding")).alias("v"))
    assert [x.v for x in v.filter("vec_id = 0").collect()] == [[128, -1]]
    assert list(map(tuple, t.top_k(v, v.filter("vec_id % 50 = 0")).collect())) == [(0, 1, 5, 128 * 256 - 256)]
    assert t.top_k(v.limit(0), v.limit(0)).count() == 0
