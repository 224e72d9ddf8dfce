import random

import pytest
from pyspark.sql import functions as F

from optrace.llm import topk


def brute_force(rows, k):
    """rows of (vec_id, vector); every row whose id is divisible by 20 asks."""
    rows = list({(i, tuple(v)) for i, v in rows if i is not None and v is not None})
    out = []
    for i, q in rows:
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i)
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def found(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, vector array<long>, score int")
    return sorted(map(tuple, topk.top_k(frame, F.col("vec_id") % 20 == 0, **more).collect()))


@pytest.mark.parametrize("more", [{}, {"k": 3, "block": 8, "shard": 50, "batch": 4}])
def test_against_brute_force(spark, more):
    pick = random.Random(6)
    rows = [(i, [pick.randrange(-9, 10) for _ in range(12)]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)]  # one very common vector
    rows += [(2000, None), (None, rows[0][1]), rows[20], rows[20], (2001, [1, 2]), (2020, [])]
    assert found(spark, rows, **more) == brute_force(rows, more.get("k", topk.K))


def test_large_weights_stay_exact(spark):
    rows = [(i, [2**30 + i, -(2**20)]) for i in range(5)] + [(20, [3, 5])]
    assert found(spark, rows) == brute_force(rows, 20)


def test_few_rows(spark):
    assert found(spark, []) == [] and found(spark, [(20, [1])]) == []
    assert found(spark, [(20, [1]), (21, [2])]) == [(20, 1, 21, 2)]


def test_quantised(spark):
    nan, inf = float("nan"), float("inf")
    frame = spark.createDataFrame([(1, [0.5, -0.01]), (2, None), (3, [None, 1.0]), (4, [nan]), (5, [inf]), (6, [])], "i int, e array<float>")
    got = {x.i: x.v for x in frame.select("i", topk.quantised(F.col("e")).alias("v")).collect()}
    assert got == {1: [32, -1], 2: None, 3: None, 4: None, 5: None, 6: []}
