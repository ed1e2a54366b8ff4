"""The engine: stored tensors by path, contracted and accumulated."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ravelgrid.errors import TensorDimsError, TensorTypeError
from ravelgrid.operators.accumulate import add
from ravelgrid.operators.contract import TASK_BYTES, contract
from ravelgrid.operators.tiles import retile, to_tiles
from ravelgrid.plans.einsum import parse
from ravelgrid.sources.store import DEFAULT_BYTES, TileStore
from ravelgrid.sources.tensor import CELLS, Tensor


class TensorEngine:
    """Holds a session and sizes, no other state.

    ``tile_bytes``: target size of tiles that ``create`` chooses.
    ``task_bytes``: what the operands and results in one task may hold.
    """

    def __init__(self, spark: SparkSession, tile_bytes: int = DEFAULT_BYTES, task_bytes: int = TASK_BYTES):
        self.spark, self.task_bytes = spark, task_bytes
        self.store = TileStore(spark, tile_bytes)

    def create(self, path: str, shape, dtype: str = "fp64", chunk=None) -> Tensor:
        return self.store.create(path, shape, dtype, chunk)

    def fill(self, path: str, value: complex | float) -> Tensor:
        return self.store.fill(path, value)

    def read(self, path: str) -> Tensor:
        return self.store.read(path)

    def contract(self, expr: str, a: str, b: str, c: str) -> Tensor:
        """``C = einsum(expr, A, B)``; C is created or replaced."""
        made = contract(expr, self.read(a), self.read(b), task_bytes=self.task_bytes)
        if not made.shape:
            raise TensorDimsError("a scalar result cannot be stored; use operators.contract")
        return self.store.write(c, made)

    def accumulate(self, expr: str, a: str, b: str, c: str) -> Tensor:
        """``C += einsum(expr, A, B)``; C must exist with the right shape and element type."""
        ta, tb, tc = self.read(a), self.read(b), self.read(c)
        shape = parse(expr).shape_of_c(ta.shape, tb.shape)
        if shape != tc.shape:
            raise TensorDimsError(f"the product has shape {shape}, C has {tc.shape}")
        if not ta.dtype == tb.dtype == tc.dtype:
            raise TensorTypeError(f"element types {ta.dtype}, {tb.dtype}, {tc.dtype}")
        made = contract(expr, ta, tb, task_bytes=self.task_bytes)
        made = to_tiles(made, tc.chunk) if made.form == CELLS else retile(made, tc.chunk)
        return self.store.write(c, add(tc, made))
