"""Accumulation ``C += einsum(expr, A, B)`` and sums of several products."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import functions as F

from ravelgrid.errors import TensorDimsError, TensorTypeError
from ravelgrid.functions.numbers import total
from ravelgrid.operators.contract import contract
from ravelgrid.operators.tiles import add_up, retile, to_tiles
from ravelgrid.sources.tensor import CELLS, Tensor


def add(first: Tensor, *others: Tensor) -> Tensor:
    """The sum of tensors of one shape and type: one union, one grouped sum.

    Tiles of another size are cut anew; cells meet tiles as tiles.
    """
    for t in others:
        if t.shape != first.shape:
            raise TensorDimsError(f"shapes {first.shape} and {t.shape}")
        if t.dtype != first.dtype:
            raise TensorTypeError(f"element types {first.dtype} and {t.dtype}")
    if not others:
        return first
    if first.form == CELLS and all(t.form == CELLS for t in others):
        rows = reduce(lambda x, y: x.unionByName(y), [t.df for t in (first, *others)])
        summed = total(F.col("v"), first.dtype).alias("v")
        return first.with_df(rows.groupBy(*first.keys).agg(summed) if first.keys else rows.agg(summed))
    chunk = first.chunk or next(t.chunk for t in others if t.chunk)
    alike = [retile(t, chunk) if t.chunk else to_tiles(t, chunk) for t in (first, *others)]
    rows = reduce(lambda x, y: x.unionByName(y), [t.df.select(*t.keys, "data") for t in alike])
    return alike[0].with_df(add_up(rows, first.rank, first.dtype))


def accumulate(expr: str, a: Tensor, b: Tensor, c: Tensor, **options) -> Tensor:
    """``c`` plus the product; c's absent parts count as zero."""
    return add(c, contract(expr, a, b, **options))


def sum_of_products(expr: str, terms: Iterable[tuple[Tensor, Tensor]], **options) -> Tensor:
    """``sum_t einsum(expr, A_t, B_t)`` with a single final sum."""
    made = [contract(expr, a, b, **options) for a, b in terms]
    if not made:
        raise TensorDimsError("no terms")
    return add(*made)
