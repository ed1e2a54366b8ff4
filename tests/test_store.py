import numpy as np
import pytest

from ravelgrid.engine import TensorEngine
from ravelgrid.errors import TensorDimsError, TensorFileError, TensorTypeError
from ravelgrid.sources.tensor import from_numpy, to_numpy


@pytest.fixture
def eng(spark):
    return TensorEngine(spark, tile_bytes=16 << 10)


def test_create_reads_back(eng, tmp_path):
    for shape, dtype in (((64, 48), "fp64"), ((12, 10, 8), "complex128")):
        t = eng.create(f"{tmp_path}/{len(shape)}", shape, dtype)
        assert t.shape == shape and t.dtype == dtype and all(c <= n for c, n in zip(t.chunk, shape)) and t.df.isEmpty()
        assert not to_numpy(t).any()


def test_bad_creates(eng, tmp_path):
    for shape in ((), (1,) * 9, (3, 0)):
        with pytest.raises(TensorDimsError):
            eng.create(f"{tmp_path}/x", shape)
    with pytest.raises(TensorTypeError):
        eng.create(f"{tmp_path}/x", (3,), "float32")
    with pytest.raises(TensorFileError):
        eng.read(f"{tmp_path}/nothing")
    with pytest.raises(TensorFileError):
        eng.fill(f"{tmp_path}/nothing", 1.0)


@pytest.mark.parametrize("shape, dtype, value", [((17, 11), "fp64", 7.5), ((9, 7), "complex128", 3 + 4j), ((25, 19, 13), "fp64", -2.0), ((5,), "fp64", 0.0)])
def test_fill(eng, tmp_path, shape, dtype, value):
    eng.create(f"{tmp_path}/t", shape, dtype, chunk=(4,) * len(shape))
    t = eng.fill(f"{tmp_path}/t", value)
    assert t.df.count() == np.prod([-(-n // 4) for n in shape])
    assert (to_numpy(t) == value).all()


@pytest.mark.parametrize("shape, chunk, tiles", [((33, 27, 21, 15), 13, 36), ((15, 12, 18, 10, 14), 8, 48)])
def test_high_rank_round_trip(eng, spark, tmp_path, shape, chunk, tiles):
    a = np.arange(float(np.prod(shape))).reshape(shape)[tuple(slice(0, 9) for _ in shape)]
    t = eng.store.write(f"{tmp_path}/t", from_numpy(spark, a, keep_zeros=True), (4,) * len(shape))
    assert np.array_equal(to_numpy(t), a)
    eng.create(f"{tmp_path}/u", shape, chunk=(chunk,) * len(shape))
    eng.fill(f"{tmp_path}/u", 1.0)
    assert eng.store.scan(f"{tmp_path}/u").count() == tiles


@pytest.mark.parametrize(
    "expr, terms, want",
    [
        ("ij,jk->ik", [((6, 8), 2.0, (8, 5), 3.0)], 48.0),
        ("ij,jk->ik", [((6, 8), 2.0, (8, 5), 3.0), ((6, 8), 1.0, (8, 5), 4.0)], 80.0),
        ("ij,jk->ki", [((6, 8), 2.0, (8, 5), 3.0), ((6, 8), 1.0, (8, 5), 4.0)], 80.0),
        ("ij,jk->ik", [((4, 5), 1.0, (5, 3), 2.0), ((4, 5), 3.0, (5, 3), 1.0), ((4, 5), 2.0, (5, 3), 2.0)], 45.0),
        ("abc,cbd->ad", [((4, 5, 3), 1.0, (3, 5, 6), 2.0), ((4, 5, 3), 2.0, (3, 5, 6), 1.5)], 75.0),
        ("ij,jk->ik", [((4, 6), 2 + 1j, (6, 4), 1 + 2j), ((4, 6), 1 + 0j, (6, 4), 3j)], 48j),
        ("ijab,akbl->klji", [((6,) * 4, 1 + 0.5j, (6,) * 4, 1 + 0.5j)], 36 * (1 + 0.5j) ** 2),
    ],
)
def test_contract_and_accumulate(eng, tmp_path, expr, terms, want):
    for n, (sa, va, sb, vb) in enumerate(terms):
        dtype = "complex128" if isinstance(va, complex) else "fp64"
        for name, shape, v in (("a", sa, va), ("b", sb, vb)):
            eng.create(f"{tmp_path}/{name}{n}", shape, dtype, chunk=(4,) * len(shape))
            eng.fill(f"{tmp_path}/{name}{n}", v)
        step = eng.accumulate if n else eng.contract
        c = step(expr, f"{tmp_path}/a{n}", f"{tmp_path}/b{n}", f"{tmp_path}/c")
    assert np.allclose(to_numpy(c), want, rtol=1e-12) and to_numpy(c).shape == c.shape


def test_accumulate_needs_a_fitting_c(eng, tmp_path):
    p = str(tmp_path)
    for name, shape, dtype in (("a", (4, 5), "fp64"), ("b", (5, 3), "fp64"), ("c", (4, 4), "fp64"), ("z", (4, 3), "complex128")):
        eng.create(f"{p}/{name}", shape, dtype)
    with pytest.raises(TensorDimsError):
        eng.accumulate("ij,jk->ik", f"{p}/a", f"{p}/b", f"{p}/c")
    with pytest.raises(TensorTypeError):
        eng.accumulate("ij,jk->ik", f"{p}/a", f"{p}/b", f"{p}/z")
    with pytest.raises(TensorFileError):
        eng.accumulate("ij,jk->ik", f"{p}/a", f"{p}/b", f"{p}/none")
    with pytest.raises(TensorDimsError):
        eng.contract("ij,ij->", f"{p}/a", f"{p}/a", f"{p}/s")


def test_accumulate_onto_sparse_c_in_other_tiles(eng, spark, tmp_path):
    p = str(tmp_path)
    rng = np.random.default_rng(1)
    a, b, c = rng.integers(-4, 5, (5, 6)) * 1.0, rng.integers(-4, 5, (6, 7)) * 1.0, np.zeros((5, 7))
    c[0, 0] = 3
    for name, x, chunk in (("a", a, (2, 3)), ("b", b, (4, 2)), ("c", c, (3, 3))):
        eng.store.write(f"{p}/{name}", from_numpy(spark, x), chunk)
    got = eng.accumulate("ij,jk->ik", f"{p}/a", f"{p}/b", f"{p}/c")
    assert got.chunk == (3, 3) and np.array_equal(to_numpy(got), c + a @ b)


def test_random_mixed_rank(eng, spark, tmp_path):
    rng = np.random.default_rng(42)
    a = rng.standard_normal((4, 3, 5, 3, 6)) + 1j * rng.standard_normal((4, 3, 5, 3, 6))
    b = rng.standard_normal((5, 6, 6, 4)) + 1j * rng.standard_normal((5, 6, 6, 4))
    eng.store.write(f"{tmp_path}/a", from_numpy(spark, a), (2,) * 5)
    eng.store.write(f"{tmp_path}/b", from_numpy(spark, b), (3,) * 4)
    c = eng.contract("abcde,cfeg->abdfg", f"{tmp_path}/a", f"{tmp_path}/b", f"{tmp_path}/c")
    assert np.allclose(to_numpy(c), np.einsum("abcde,cfeg->abdfg", a, b), rtol=1e-12, atol=1e-12)
