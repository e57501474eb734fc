import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stafflens.llm import topk


def _plain(rows, k=10):
    def vector(v):
        fine = v and all(x is not None and np.isfinite(x) for x in v)
        return [int(np.floor(1024 * float(x))) for x in v] if fine else None

    some = [(i, vector(v)) for i, v in rows if i is not None and vector(v)]
    out = []
    for q, x in some:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in some if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def _run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int").repartition(3)
    return sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 100 == 0, **options).collect())


def test_equals_all_pairs(spark):
    rng = random.Random(1)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(16)]) for i in range(900)]
    rows[5] = (5, None)
    rows[6] = (6, [float("nan")] * 16)
    rows[7] = (7, [None] + [0.0] * 15)
    rows[8] = (8, [float("inf")] * 16)
    rows[9] = (9, [])
    rows[10] = (None, [1.0] * 16)
    rows[300] = (300, None)
    rows[11] = (11, [0.5] * 4)  # shorter
    same = rows[50][1]
    rows += [(i, same) for i in range(2000, 2060)]  # ties, one of them a query
    assert _run(spark, rows) == _plain(rows)
    assert _run(spark, rows, block_rows=100) == _plain(rows)


def test_few_candidates_and_empty(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 0.0]), (3, [0.0, -1.0])]
    assert _run(spark, rows) == _plain(rows)
    assert _run(spark, rows[:1]) == [] and _run(spark, rows[1:]) == []
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(empty, F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("n", [1, 3, 40, 700])
def test_bounds_hold_and_prune_rightly(n):
    rng = np.random.default_rng(n)
    vectors = rng.integers(-50, 50, (n, 8))
    queries = rng.integers(-50, 50, (5, 8))
    lists = topk.SortedLists(vectors)
    exact = vectors @ queries.T
    for depth in {1, max(1, n // 3), n}:
        lower, upper = lists.bounds(np.maximum(queries.T, 0), np.minimum(queries.T, 0), depth)
        assert (lower <= exact).all() and (exact <= upper).all()
    ids = np.arange(n)
    for j, found in enumerate(lists.top(queries, 10, ids, np.full(5, -1))):
        assert found == sorted(((i, int(exact[i, j])) for i in ids), key=lambda x: (-x[1], x[0]))[:10]


def test_components_and_scores_of_any_size(spark):
    """Finite components beyond 2^53 and scores beyond a long: whole numbers, held at the ends."""
    rng = random.Random(9)
    ends = (-(1 << 63), (1 << 63) - 1)

    def held(x):
        return min(max(x, ends[0]), ends[1])

    def plain(rows):
        some = [(i, [held(int(np.floor(1024.0 * x))) for x in v]) for i, v in rows]
        out = []
        for q, x in some:
            if q % 100 == 0:
                scores = sorted((-held(sum(a * b for a, b in zip(x, y))), i) for i, y in some if i != q)[:10]
                out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
        return sorted(out)

    for size in (2.0**17, 2.0**20, 2.0**30, 1e300):
        rows = [(i, [rng.choice([-1, 1]) * rng.random() * size for _ in range(5)]) for i in range(400)]
        rows += [(1000 + i, [size, size, 1.0 + i / 1024, 0.5, size]) for i in range(40)]  # near ties
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
        for block in (64, 4096):
            got = sorted(tuple(r) for r in topk.search(df, F.col("vec_id") % 100 == 0, block_rows=block).collect())
            assert got == plain(rows), size


def test_lists_are_read_until_outsiders_cannot_qualify():
    rng = np.random.default_rng(3)
    vectors = np.zeros((2000, 4), dtype=np.int64)
    vectors[:, 0] = rng.permutation(2000)  # one list decides: a quarter of it is enough
    lists = topk.SortedLists(vectors)
    found = lists.top(np.array([[5, 0, 0, 0]]), 10, np.arange(2000), np.array([-1]))
    assert [score for _, score in found[0]] == [5 * x for x in range(1999, 1989, -1)]
    assert lists.entries == [500, 2000]
