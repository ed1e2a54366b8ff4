"""Index arithmetic as column expressions: tiles, offsets, row-major numbers."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F


def grid(shape: Sequence[int], chunk: Sequence[int]) -> tuple[int, ...]:
    """Tiles per dimension."""
    return tuple(-(-n // c) for n, c in zip(shape, chunk))


def strides(shape: Sequence[int]) -> tuple[int, ...]:
    """Row-major strides in elements."""
    return tuple(prod(shape[d + 1 :]) for d in range(len(shape)))


def flat_index(coords: Sequence[Column], shape: Sequence[int]) -> Column:
    """Row-major number of a coordinate."""
    total = F.lit(0).cast("long")
    for c, s in zip(coords, strides(shape)):
        total = total + c.cast("long") * F.lit(s)
    return total


def unravel(flat: Column, shape: Sequence[int]) -> list[Column]:
    """Coordinates of a row-major number."""
    return [F.floor(flat / F.lit(s)).cast("long") % F.lit(n) if s > 1 else flat % F.lit(n) for s, n in zip(strides(shape), shape)]


def tile_of(index: Column, chunk: int) -> Column:
    """The tile an index lies in."""
    return F.floor(index / F.lit(chunk)).cast("int")


def tile_offset(tile: Column, chunk: int) -> Column:
    """The first index of a tile."""
    return tile.cast("long") * F.lit(chunk)


def tile_extent(tile: Column, chunk: int, size: int) -> Column:
    """How many indices of a dimension a tile holds (boundary tiles hold fewer)."""
    return F.least(F.lit(chunk), F.lit(size) - tile * F.lit(chunk)).cast("int")
