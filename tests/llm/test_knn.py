import math
import random

import pytest

from ravelgrid.llm import knn


def brute(rows, k=10):
    ok = [
        (n, i, [math.floor(1024 * c) for c in v]) for n, (i, v) in enumerate(rows)
        if i is not None and v and all(c is not None and math.isfinite(c) for c in v)
    ]
    out = []
    for n, i, q in ok:
        if i % 100 == 0:
            found = sorted((-sum(a * b for a, b in zip(q, v)), j) for m, j, v in ok if m != n)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


def rows(rng, n, hot):
    out = [(i, [rng.uniform(-1, 1) + (i % 7) for _ in range(6)]) for i in range(n)]
    if hot:
        same = [0.5, -0.25, 1.0, 2.0, 0.0, 3.0]
        out = [(i, same if i % 3 == 0 else v) for i, v in out]
    return out + [(1000, None), (1100, []), (1200, [1.0, None]), (1300, [float("nan")] * 6), (1400, [float("inf")] * 6), (None, [1.0] * 6), (1500, [1.0, 2.0]), (100, [9.0] * 6)]


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("group", [2048, 2])
def test_equals_brute_force(spark, hot, group):
    data = rows(random.Random(4), 700, hot)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(5)
    got = sorted(tuple(r) for r in knn.top_k(df, pivots=8, group_queries=group).collect())
    assert got == brute(data)


def test_large_components_and_few_rows(spark):
    big = [(0, [3e5, 1.0]), (1, [3e5, 2.0]), (2, [3e5 + 1e-3, -5.0])]
    got = sorted(tuple(r) for r in knn.top_k(spark.createDataFrame(big, "vec_id long, embedding array<double>")).collect())
    assert got == brute(big)
    assert knn.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert knn.top_k(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")).collect() == []
    assert knn.top_k(spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>")).collect() == []


def test_far_cells_are_not_replicated():
    import numpy as np

    rng = np.random.default_rng(0)
    near, far = rng.normal(0, 1, (200, 4)), rng.normal(0, 1, (200, 4))
    near[:, 0] += 50
    far[:, 0] -= 50
    x = np.vstack([near, far])
    top = float(np.sqrt((x * x).sum(1).max()))
    pick = x[[0, 50, 250, 300]]
    cells = knn.Cells(np.hstack([pick, np.sqrt(np.maximum(top**2 - (pick * pick).sum(1), 0))[:, None]]), top, 4)
    cell, dist = cells.assign(x, query=False)
    nearest = {int(c): sorted(dist[cell == c])[:4] for c in np.unique(cell)}
    q_cell, q_dist = cells.assign(near[:5], query=True)
    cells.bound(3, nearest, {int(c): float(q_dist[q_cell == c].max()) for c in np.unique(q_cell)}, {int(c): int((q_cell == c).sum()) for c in np.unique(q_cell)}, 100)
    want = cells.wanted(cell, dist).any(axis=1)
    assert not want[200:].any()
    for q in near[:5]:
        best = np.argsort(-(x @ q), kind="stable")[:4]
        assert want[best].all()


def test_other_columns_do_no_harm(spark):
    from pyspark.sql import functions as F

    data = rows(random.Random(5), 300, False)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    for c in ("score", "rank", "uid", "v", "query_id", "grp", "salt", "cell"):
        df = df.withColumn(c, F.lit("x"))
    assert sorted(tuple(r) for r in knn.top_k(df).collect()) == brute(data)
