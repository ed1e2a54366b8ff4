import importlib.util

import numpy as np
import pytest

from ravelgrid.__main__ import main
from ravelgrid.errors import TensorDimsError, TensorFileError
from ravelgrid.operators.products import matmul, pair_product
from ravelgrid.operators.tiles import to_tiles
from ravelgrid.plans.report import report
from ravelgrid.sources.hdf5 import read_hdf5
from ravelgrid.sources.store import TileStore
from ravelgrid.sources.tensor import from_numpy, to_numpy


def test_named_products(spark):
    rng = np.random.default_rng(0)
    a, b = rng.integers(-3, 4, (3, 4)) * 1.0, rng.integers(-3, 4, (4, 2)) * 1.0
    assert np.array_equal(to_numpy(matmul(from_numpy(spark, a), from_numpy(spark, b))), a @ b)
    p, q = rng.integers(-3, 4, (2, 3, 2, 2)) * 1.0, rng.integers(-3, 4, (2, 3, 2, 4)) * 1.0
    got = to_numpy(pair_product(to_tiles(from_numpy(spark, p), (2, 2, 1, 2)), to_tiles(from_numpy(spark, q), (1, 2, 2, 3))))
    assert np.array_equal(got, np.einsum("ijab,akbl->klji", p, q))
    for bad in (matmul, pair_product):
        with pytest.raises(TensorDimsError):
            bad(from_numpy(spark, np.ones(3)), from_numpy(spark, b))


def test_report_counts_present_tiles(spark):
    a = np.zeros((8, 8))
    a[:4, :4] = 1
    t = to_tiles(from_numpy(spark, a), (4, 4))
    r = report("ij,jk->ik", t, t)
    assert (r.tiles_a, r.present_a, r.flops) == (4, 1, 2 * 8**3) and "1 of 4" in str(r)
    with pytest.raises(TensorDimsError):
        report("ij,jk->ik", t, from_numpy(spark, a))


def test_command_line(spark, tmp_path, capsys):
    p = str(tmp_path)
    assert main(["create", f"{p}/a", "30x30", "--value", "1"], spark) == 0
    assert main(["create", f"{p}/b", "30x30"], spark) == 0 and main(["fill", f"{p}/b", "2"], spark) == 0
    assert main(["contract", "ik,kj->ij", f"{p}/a", f"{p}/b", f"{p}/c"], spark) == 0
    assert main(["accumulate", "ik,kj->ij", f"{p}/a", f"{p}/b", f"{p}/c"], spark) == 0
    assert main(["scan", f"{p}/c"], spark) == 0 and "30x30" in capsys.readouterr().out
    assert (to_numpy(TileStore(spark).read(f"{p}/c")) == 120.0).all()
    assert main(["contract", "ik,kj", f"{p}/a", f"{p}/b", f"{p}/c"], spark) == 3
    assert main(["scan", f"{p}/none"], spark) == 1


@pytest.mark.skipif(importlib.util.find_spec("h5py") is not None, reason="h5py is installed")
def test_hdf5_needs_its_package(spark):
    with pytest.raises(TensorFileError):
        read_hdf5(spark, "/nowhere.h5")
