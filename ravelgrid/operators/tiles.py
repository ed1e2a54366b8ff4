"""Tiles: to and from cells, transposed, cut anew, added up."""

from __future__ import annotations

from itertools import product
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelgrid.errors import TensorDimsError
from ravelgrid.functions.numbers import FP64
from ravelgrid.sources.tensor import Tensor


def np_type(dtype: str):
    return np.float64 if dtype == FP64 else np.complex128


def extents(coords, chunk, shape) -> tuple[int, ...]:
    """Actual extents of a tile."""
    return tuple(min(c, n - t * c) for t, c, n in zip(coords, chunk, shape))


def tile_schema(rank: int) -> str:
    return ", ".join([*(f"t{d} int" for d in range(rank)), "data binary"])


def tile_table(rows: list[tuple], rank: int) -> pa.Table:
    """(coords, array) rows as an Arrow table in the tile schema."""
    columns = [pa.array([c[d] for c, _ in rows], pa.int32()) for d in range(rank)]
    data = pa.array([np.ascontiguousarray(a).tobytes() for _, a in rows], pa.binary())
    return pa.table([*columns, data], names=[*(f"t{d}" for d in range(rank)), "data"])


def tile_rows(table, rank: int, chunk, shape, dtype):
    """(coords, array) of each row of an Arrow table or batch in the tile schema."""
    coords = [table.column(f"t{d}").to_pylist() for d in range(rank)]
    data = table.column("data")
    for i in range(table.num_rows):
        at = tuple(c[i] for c in coords)
        yield at, np.frombuffer(data[i].as_buffer(), np_type(dtype)).reshape(extents(at, chunk, shape))


def to_tiles(t: Tensor, chunk) -> Tensor:
    """Cells to tiles; a tile is present if any of its cells is.

    Within a tile a group is at most the tile's elements.  Coordinates outside
    the shape are an error, repeated ones too (``from_dataframe`` adds them up).
    """
    chunk, shape, dtype, rank = tuple(chunk), t.shape, t.dtype, t.rank
    if len(chunk) != rank or any(c < 1 for c in chunk):
        raise TensorDimsError(f"tile {chunk} for shape {shape}")
    keys = [f"t{d}" for d in range(rank)]
    cells = t.df.select(
        *[F.floor(F.col(f"i{d}") / chunk[d]).cast("int").alias(f"t{d}") for d in range(rank)],
        *[F.col(f"i{d}") for d in range(rank)],
        *([F.col("v").alias("re")] if dtype == FP64 else [F.col("v.r").alias("re"), F.col("v.i").alias("im")]),
    )

    def build(table: pa.Table) -> pa.Table:
        at = tuple(table.column(k)[0].as_py() for k in keys)
        ext = extents(at, chunk, shape)
        places = np.zeros(table.num_rows, np.int64)
        for d in range(rank):
            local = table.column(f"i{d}").to_numpy() - at[d] * chunk[d]
            if ((local < 0) | (local >= ext[d])).any():
                raise TensorDimsError(f"a cell outside the shape {shape}")
            places = places * ext[d] + local
        if len(np.unique(places)) != len(places):
            raise TensorDimsError("a coordinate occurs twice")
        out = np.zeros(prod(ext), np_type(dtype))
        out[places] = table.column("re").to_numpy() if dtype == FP64 else table.column("re").to_numpy() + 1j * table.column("im").to_numpy()
        return tile_table([(at, out)], rank)

    return Tensor(cells.groupBy(*keys).applyInArrow(build, tile_schema(rank)), shape, dtype, chunk)


def to_cells(t: Tensor) -> Tensor:
    """Every element of every present tile as a cell, zeros included."""
    chunk, shape, dtype, rank = t.chunk, t.shape, t.dtype, t.rank

    def explode(batches):
        for batch in batches:
            for at, a in tile_rows(batch, rank, chunk, shape, dtype):
                idx = np.indices(a.shape).reshape(rank, -1)
                columns = [pa.array(idx[d] + at[d] * chunk[d]) for d in range(rank)]
                flat = a.reshape(-1)
                values = [pa.array(flat)] if dtype == FP64 else [pa.array(flat.real.copy()), pa.array(flat.imag.copy())]
                yield pa.record_batch(
                    [*columns, *values], names=[*(f"i{d}" for d in range(rank)), *(["v"] if dtype == FP64 else ["re", "im"])]
                )

    values = "v double" if dtype == FP64 else "re double, im double"
    df = t.df.select(*t.keys, "data").mapInArrow(explode, ", ".join([*(f"i{d} long" for d in range(rank)), values]))
    if dtype != FP64:
        df = df.select(*[f"i{d}" for d in range(rank)], F.struct(F.col("re").alias("r"), F.col("im").alias("i")).alias("v"))
    return Tensor(df, shape, dtype)


def transpose_tiles(t: Tensor, order: tuple[int, ...]) -> Tensor:
    chunk, shape, dtype, rank = t.chunk, t.shape, t.dtype, t.rank

    def turn(batches):
        for batch in batches:
            rows = [(tuple(at[d] for d in order), a.transpose(order)) for at, a in tile_rows(batch, rank, chunk, shape, dtype)]
            yield from tile_table(rows, rank).to_batches()

    if order == tuple(range(rank)):
        return t
    df = t.df.select(*t.keys, "data").mapInArrow(turn, tile_schema(rank))
    return Tensor(df, tuple(shape[d] for d in order), dtype, tuple(chunk[d] for d in order))


def retile(t: Tensor, chunk) -> Tensor:
    """The same tensor in tiles of another size: pieces travel to their new tile, present tiles stay present."""
    old, new, shape, dtype, rank = t.chunk, tuple(chunk), t.shape, t.dtype, t.rank
    if new == old:
        return t
    keys = [f"t{d}" for d in range(rank)]

    def cut(batches):
        for batch in batches:
            for at, a in tile_rows(batch, rank, old, shape, dtype):
                start = [x * c for x, c in zip(at, old)]
                reach = [range(s // n, (s + e - 1) // n + 1) for s, e, n in zip(start, a.shape, new)]
                rows = []
                for target in product(*reach):
                    lo = [max(s, x * n) for s, x, n in zip(start, target, new)]
                    hi = [min(s + e, (x + 1) * n) for s, e, x, n in zip(start, a.shape, target, new)]
                    piece = a[tuple(slice(p - s, q - s) for p, q, s in zip(lo, hi, start))]
                    rows.append((target, [p - x * n for p, x, n in zip(lo, target, new)], piece))
                yield pa.record_batch(
                    [
                        *(pa.array([r[0][d] for r in rows], pa.int32()) for d in range(rank)),
                        pa.array([r[1] for r in rows], pa.list_(pa.int32())),
                        pa.array([list(r[2].shape) for r in rows], pa.list_(pa.int32())),
                        pa.array([np.ascontiguousarray(r[2]).tobytes() for r in rows], pa.binary()),
                    ],
                    names=[*keys, "at", "ext", "data"],
                )

    def join(table: pa.Table) -> pa.Table:
        tile = tuple(table.column(k)[0].as_py() for k in keys)
        out = np.zeros(extents(tile, new, shape), np_type(dtype))
        for at, ext, data in zip(*(table.column(c).to_pylist() for c in ("at", "ext", "data"))):
            out[tuple(slice(p, p + e) for p, e in zip(at, ext))] = np.frombuffer(data, np_type(dtype)).reshape(ext)
        return tile_table([(tile, out)], rank)

    pieces = t.df.select(*keys, "data").mapInArrow(
        cut, ", ".join([*(f"{k} int" for k in keys), "at array<int>", "ext array<int>", "data binary"])
    )
    return Tensor(pieces.groupBy(*keys).applyInArrow(join, tile_schema(rank)), shape, dtype, new)


def add_up(df: DataFrame, rank: int, dtype: str) -> DataFrame:
    """Tiles with equal keys become one, their elementwise sum."""
    keys = [f"t{d}" for d in range(rank)]

    def total(table: pa.Table) -> pa.Table:
        at = tuple(table.column(k)[0].as_py() for k in keys)
        data = table.column("data")
        out = np.frombuffer(data[0].as_buffer(), np_type(dtype)).copy()
        for i in range(1, table.num_rows):
            out += np.frombuffer(data[i].as_buffer(), np_type(dtype))
        return tile_table([(at, out)], rank)

    return df.groupBy(*keys).applyInArrow(total, tile_schema(rank))
