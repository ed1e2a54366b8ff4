"""A tensor: a DataFrame of cells or of tiles, and what cannot be read off sparse rows.

Cells: one row per cell, ``i0 .. i{n-1}: bigint`` and ``v``.
Tiles: one row per present tile, ``t0 .. t{n-1}: int`` and ``data: binary``, the
tile's elements (actual extents, row-major, little-endian doubles; complex:
real and imaginary part in turn).  An absent row is a tile (or cell) of zeros.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from math import prod

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelgrid.errors import TensorDimsError
from ravelgrid.functions import index
from ravelgrid.functions.numbers import ELEMENT_BYTES, FP64, check_dtype, total, zero_of

CELLS, TILES = "cells", "tiles"


@dataclass(frozen=True)
class Tensor:
    df: DataFrame
    shape: tuple[int, ...]
    dtype: str = FP64
    chunk: tuple[int, ...] | None = None

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def form(self) -> str:
        return CELLS if self.chunk is None else TILES

    @property
    def keys(self) -> list[str]:
        return [f"{'i' if self.form == CELLS else 't'}{d}" for d in range(self.rank)]

    @property
    def grid(self) -> tuple[int, ...]:
        return index.grid(self.shape, self.chunk)

    @property
    def dense_bytes(self) -> int:
        return prod(self.shape) * ELEMENT_BYTES[self.dtype]

    def with_df(self, df: DataFrame) -> Tensor:
        return replace(self, df=df)


def from_dataframe(
    df: DataFrame, labels: Sequence[str], value: str, shape: Sequence[int], dtype: str = FP64, combine: bool = True
) -> Tensor:
    """Cells from any table: label columns become coordinates, values of equal coordinates are added up.

    ``combine=False`` promises that coordinates are unique and saves the shuffle.
    Rows with a null coordinate or value are no cells.
    """
    if len(labels) != len(shape):
        raise TensorDimsError(f"{len(labels)} labels for {len(shape)} dims")
    kind = "double" if check_dtype(dtype) == FP64 else "struct<r:double,i:double>"
    keys = [F.col(x).cast("long").alias(f"i{d}") for d, x in enumerate(labels)]
    cells = df.select(*keys, F.col(value).cast(kind).alias("v")).dropna()
    if combine:
        cells = cells.groupBy(*[f"i{d}" for d in range(len(labels))]).agg(total(F.col("v"), dtype).alias("v"))
    return Tensor(cells, tuple(shape), dtype)


def from_numpy(spark, array: np.ndarray, keep_zeros: bool = False) -> Tensor:
    """Cells of a small array (tests, examples)."""
    dtype = "complex128" if np.iscomplexobj(array) else FP64
    where = np.argwhere(np.ones(array.shape, bool) if keep_zeros else array != 0)
    cell = (lambda x: (float(x.real), float(x.imag))) if dtype != FP64 else float
    rows = [(*map(int, at), cell(array[tuple(at)])) for at in where]
    schema = ", ".join([*(f"i{d} long" for d in range(array.ndim)), "v " + ("double" if dtype == FP64 else "struct<r:double,i:double>")])
    return Tensor(spark.createDataFrame(rows, schema), array.shape, dtype)


def to_numpy(t: Tensor) -> np.ndarray:
    """A small tensor as an array (tests, examples)."""
    from ravelgrid.operators.tiles import to_cells

    cells = t if t.form == CELLS else to_cells(t)
    out = np.zeros(t.shape, np.float64 if t.dtype == FP64 else np.complex128)
    for row in cells.df.collect():
        v = row["v"]
        out[tuple(row[k] for k in cells.keys)] = v if t.dtype == FP64 else complex(v["r"], v["i"])
    return out


def to_dense(t: Tensor) -> Tensor:
    """Every cell as a row, absent ones with zero."""
    spark = t.df.sparkSession
    n = prod(t.shape)
    all_cells = spark.range(n).select(*[c.alias(k) for c, k in zip(index.unravel(F.col("id"), t.shape), t.keys)])
    filled = all_cells.join(t.df, t.keys, "left")
    return t.with_df(filled.select(*t.keys, F.coalesce(F.col("v"), zero_of(t.dtype)).alias("v")))


def permute(t: Tensor, order: Sequence[int]) -> Tensor:
    """Axes in another order: for cells a renaming, for tiles a transposition of each."""
    if sorted(order) != list(range(t.rank)):
        raise TensorDimsError(f"{list(order)} is no order of {t.rank} axes")
    shape = tuple(t.shape[d] for d in order)
    if t.form == CELLS:
        df = t.df.select(*[F.col(f"i{d}").alias(f"i{k}") for k, d in enumerate(order)], "v")
        return Tensor(df, shape, t.dtype)
    from ravelgrid.operators.tiles import transpose_tiles

    return transpose_tiles(t, tuple(order))
