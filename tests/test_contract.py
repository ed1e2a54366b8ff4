import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ravelgrid.errors import TensorDimsError, TensorTypeError
from ravelgrid.operators.accumulate import accumulate, add, sum_of_products
from ravelgrid.operators.contract import choose_blocks, contract
from ravelgrid.operators.tiles import retile, to_cells, to_tiles
from ravelgrid.sources.store import lookup, scan
from ravelgrid.sources.tensor import from_dataframe, from_numpy, permute, to_dense, to_numpy

SIZES = dict(zip("abcdefgijklm", (2, 3, 4, 5, 3, 2, 4, 5, 6, 7, 3, 2)))
CLASSES = ["ij,jk->ik", "ij,jk->ki", "abc,cbd->ad", "ijab,akbl->klji", "abcde,cfeg->abdfg", "i,ij->j", "i,j->ij", "ij,j->i"]


def random_array(rng, labels, cplx, sparse=0.0):
    shape = [SIZES[x] for x in labels]
    a = rng.integers(-5, 6, shape).astype(float)
    if cplx:
        a = a + 1j * rng.integers(-5, 6, shape)
    return np.where(rng.random(shape) < sparse, 0, a)


@pytest.mark.parametrize("cplx", [False, True])
@pytest.mark.parametrize("expr", CLASSES)
def test_cells_equal_numpy(spark, expr, cplx):
    rng = np.random.default_rng(len(expr))
    a, b = (random_array(rng, x, cplx, 0.3) for x in expr.split("->")[0].split(","))
    got = to_numpy(contract(expr, from_numpy(spark, a), from_numpy(spark, b)))
    assert np.array_equal(got, np.einsum(expr, a, b))


@pytest.mark.parametrize("cplx", [False, True])
@pytest.mark.parametrize("expr", CLASSES)
@pytest.mark.parametrize("task_bytes", [1 << 30, 400])
def test_tiles_equal_numpy(spark, expr, cplx, task_bytes):
    rng = np.random.default_rng(len(expr) + 1)
    la, lb = expr.split("->")[0].split(",")
    a, b = random_array(rng, la, cplx), random_array(rng, lb, cplx)
    # tile sides do not agree on the contracted labels
    ta = to_tiles(from_numpy(spark, a), [2] * a.ndim)
    tb = to_tiles(from_numpy(spark, b), [3] * b.ndim)
    made = contract(expr, ta, tb, task_bytes=task_bytes)
    assert np.array_equal(to_numpy(made), np.einsum(expr, a, b))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.data())
def test_block_sparse_tiles(spark, data):
    rng = np.random.default_rng(data.draw(st.integers(0, 1000)))
    a, b = random_array(rng, "ijk", False), random_array(rng, "kjl", False)
    for x in (a, b):
        for _ in range(data.draw(st.integers(0, 6))):
            at = tuple(slice(2 * (t := rng.integers(0, -(-n // 2))), 2 * t + 2) for n in x.shape)
            x[at] = 0
    ta, tb = (to_tiles(from_numpy(spark, x), (2, 2, 2)) for x in (a, b))
    assert np.array_equal(to_numpy(contract("ijk,kjl->il", ta, tb)), np.einsum("ijk,kjl->il", a, b))


def test_absent_times_nan_is_nothing_and_zero_times_nan_is_nan(spark):
    a = np.zeros((4, 4))
    a[0, 0] = np.nan
    b = np.ones((4, 4))
    b[0:2] = 0
    ta = to_tiles(from_numpy(spark, a, keep_zeros=True), (2, 2))
    absent = to_tiles(from_numpy(spark, b), (2, 2))
    stored = to_tiles(from_numpy(spark, b, keep_zeros=True), (2, 2))
    assert not np.isnan(to_numpy(contract("ij,jk->ik", ta, absent))).any()
    assert np.isnan(to_numpy(contract("ij,jk->ik", ta, stored))[0]).all()


def test_scalar_result_also_over_nothing(spark):
    a = np.arange(6.0).reshape(2, 3)
    t = from_numpy(spark, a)
    assert contract("ij,ij->", t, t).df.collect()[0].v == 55.0
    assert contract("ij,ij->", t, t.with_df(t.df.limit(0))).df.collect()[0].v == 0.0
    assert contract("ij,ij->", to_tiles(t, (2, 2)), t).df.collect()[0].v == 55.0


def test_batch(spark):
    rng = np.random.default_rng(0)
    a, b = random_array(rng, "bij", False), random_array(rng, "bjk", False)
    for x, y in ((from_numpy(spark, a), from_numpy(spark, b)), (to_tiles(from_numpy(spark, a), (2, 2, 2)), to_tiles(from_numpy(spark, b), (2, 2, 2)))):
        assert np.array_equal(to_numpy(contract("bij,bjk->bik", x, y, allow_batch=True)), np.einsum("bij,bjk->bik", a, b))


@pytest.mark.parametrize("tiled", [False, True])
def test_accumulate_and_sums(spark, tiled):
    rng = np.random.default_rng(9)
    terms = [(random_array(rng, "ij", True), random_array(rng, "jk", True)) for _ in range(3)]
    made = [tuple(from_numpy(spark, x) for x in t) for t in terms]
    if tiled:
        made = [(to_tiles(x, (2, 2)), to_tiles(y, (3, 4))) for x, y in made]
    want = sum(a @ b for a, b in terms)
    assert np.array_equal(to_numpy(sum_of_products("ij,jk->ik", made)), want)
    c = contract("ij,jk->ik", *made[0])
    for t in made[1:]:
        c = accumulate("ij,jk->ik", *t, c)
    assert np.array_equal(to_numpy(c), want)
    if tiled:  # C in other tiles than the product
        odd = to_tiles(to_cells(contract("ij,jk->ik", *made[0])), (4, 3))
        assert np.array_equal(to_numpy(accumulate("ij,jk->ik", *made[1], odd)), terms[0][0] @ terms[0][1] + terms[1][0] @ terms[1][1])


def test_mismatches(spark):
    a, b = from_numpy(spark, np.ones((2, 3))), from_numpy(spark, np.ones((4, 2)))
    with pytest.raises(TensorDimsError):
        contract("ij,jk->ik", a, b)
    with pytest.raises(TensorTypeError):
        contract("ij,jk->ik", b, from_numpy(spark, np.ones((2, 2)) * 1j))
    with pytest.raises(TensorDimsError):
        add(a, b)
    with pytest.raises(TensorDimsError):
        sum_of_products("ij,jk->ik", [])
    with pytest.raises(TensorDimsError):
        permute(a, (0, 0))


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1), (1, 0, 2)])
def test_permute(spark, order):
    a = np.arange(1.0, 25.0).reshape(2, 3, 4)
    t = from_numpy(spark, a)
    for x in (t, to_tiles(t, (2, 2, 3))):
        assert np.array_equal(to_numpy(permute(x, order)), a.transpose(order))


@pytest.mark.parametrize("old, new", [((2, 3), (3, 2)), ((5, 7), (2, 2)), ((2, 2), (5, 7)), ((3, 3), (3, 3))])
def test_retile(spark, old, new):
    a = np.arange(1.0, 36.0).reshape(5, 7)
    t = retile(to_tiles(from_numpy(spark, a), old), new)
    assert t.chunk == new and np.array_equal(to_numpy(t), a)


def test_cells_outside_or_twice(spark):
    df = spark.createDataFrame([(0, 9, 1.0)], "a int, b int, x double")
    with pytest.raises(Exception, match="outside"):
        to_tiles(from_dataframe(df, ["a", "b"], "x", (2, 3)), (2, 2)).df.collect()
    two = spark.createDataFrame([(0, 1, 1.0), (0, 1, 2.0), (None, 1, 1.0), (1, 1, None)], "a int, b int, x double")
    with pytest.raises(Exception, match="twice"):
        to_tiles(from_dataframe(two, ["a", "b"], "x", (2, 3), combine=False), (2, 2)).df.collect()
    assert to_numpy(from_dataframe(two, ["a", "b"], "x", (2, 3))).sum() == 3.0


def test_dense_scan_and_lookup(spark):
    a = np.zeros((300, 10, 10))
    for t in range(3):
        a[t * 100, t * 4, t * 4] = t + 1
    t = to_tiles(from_numpy(spark, a), (100, 4, 4))
    assert scan(t).count() == 3
    assert lookup(t, (1, 1, 1)).count() == 1 and lookup(t, (0, 1, 0)).count() == 0 and lookup(t, (9, 9, 9)).count() == 0
    small = from_numpy(spark, np.diag([1.0, 2.0]))
    assert to_dense(small).df.count() == 4 and np.array_equal(to_numpy(to_dense(small)), np.diag([1.0, 2.0]))


def test_block_plans_fit_their_tasks():
    for fa, fb, fk in ((49, 49, 49), (1, 1, 1000), (1000, 1, 1), (400, 400, 400)):
        a, b, c = fa * fk << 20, fk * fb << 20, fa * fb << 20
        p = choose_blocks(a, b, c, fa, fb, fk, 192 << 20, 8)
        assert a / (p.ga * p.gk) + b / (p.gb * p.gk) + c / (p.ga * p.gb) <= max(192 << 20, 3 << 20)
        assert p.ga <= fa and p.gb <= fb and p.gk <= fk
    assert choose_blocks(1000, 1000, 1000, 10, 10, 10, 1 << 30, 1).gk == 1


def test_plan_of_cells_prunes_and_pushes(spark):
    from ravelgrid.queries import queries

    plan = queries()["contract_matmul"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "l_comment" not in plan and "Python" not in plan


def test_the_shape_does_not_change_the_result(spark):
    """Two cells, NaN among them, at a small and at a huge shape: the same cells, and never tiles."""
    for n in (100, 1000, 10**9):
        a = from_dataframe(spark.createDataFrame([(1, 2, float("nan")), (3, 4, 5.0)], "i long, j long, val double"), ["i", "j"], "val", [n, n])
        b = from_dataframe(spark.createDataFrame([(4, 6, 7.0), (9, 9, float("nan"))], "j long, k long, val double"), ["j", "k"], "val", [n, n])
        c = contract("ij,jk->ik", a, b)
        assert c.form == "cells" and [tuple(r) for r in c.df.collect()] == [(3, 6, 35.0)]
