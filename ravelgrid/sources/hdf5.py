"""Tensors in HDF5 files, where the h5py package is installed.

One task reads one range of tiles by hyperslab; the file must lie where every
executor can open it.  Compound elements with fields ``r`` and ``i`` are
complex, everything else is read as doubles.
"""

from __future__ import annotations

from math import prod

import numpy as np
from pyspark.sql import SparkSession

from ravelgrid.errors import TensorFileError
from ravelgrid.functions import index
from ravelgrid.functions.numbers import COMPLEX128, FP64
from ravelgrid.operators.tiles import extents, np_type, tile_schema, tile_table
from ravelgrid.plans.einsum import check_rank
from ravelgrid.sources.tensor import Tensor


def _h5py():
    try:
        import h5py
    except ImportError as e:
        raise TensorFileError("reading HDF5 needs the h5py package") from e
    return h5py


def read_hdf5(spark: SparkSession, path: str, dataset: str = "tensor") -> Tensor:
    """Tiles of a chunked dataset (all tiles; unwritten chunks read as zeros are left out)."""
    with _h5py().File(path, "r") as f:
        if dataset not in f:
            raise TensorFileError(f"no dataset {dataset!r} in {path}")
        d = f[dataset]
        shape = check_rank(d.shape)
        chunk = tuple(d.chunks or d.shape)
        dtype = COMPLEX128 if d.dtype.names or d.dtype.kind == "c" else FP64
    grid = index.grid(shape, chunk)

    def load(batches):
        with _h5py().File(path, "r") as f:
            d = f[dataset]
            for batch in batches:
                for n in batch.column(0).to_pylist():
                    at = tuple(int(x) for x in np.unravel_index(n, grid))
                    ext = extents(at, chunk, shape)
                    x = d[tuple(slice(t * c, t * c + e) for t, c, e in zip(at, chunk, ext))]
                    x = x["r"] + 1j * x["i"] if x.dtype.names else x.astype(np_type(dtype))
                    if x.any():
                        yield from tile_table([(at, x)], len(shape)).to_batches()

    return Tensor(spark.range(prod(grid)).mapInArrow(load, tile_schema(len(shape))), shape, dtype, chunk)
