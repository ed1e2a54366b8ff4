"""What a tiled contraction will move, and what is there to move.

Theory comes from shapes and the block plan, presence from one scan of tile
keys (the data column is pruned away).
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

from pyspark.sql import functions as F

from ravelgrid.errors import TensorDimsError
from ravelgrid.functions.numbers import ELEMENT_BYTES
from ravelgrid.operators.contract import TASK_BYTES, BlockPlan, block_plan
from ravelgrid.plans.einsum import label_sizes, parse
from ravelgrid.sources.tensor import TILES, Tensor


@dataclass(frozen=True)
class Report:
    blocks: BlockPlan
    flops: int
    tiles_a: int
    tiles_b: int
    present_a: int
    present_b: int
    shuffled_bytes: int
    naive_bytes: int

    def __str__(self) -> str:
        return (
            f"groups {self.blocks.ga} x {self.blocks.gb}, slabs {self.blocks.gk}; {self.flops:.3g} flops; A {self.present_a} of {self.tiles_a} tiles, "
            f"B {self.present_b} of {self.tiles_b}; shuffles at most {self.shuffled_bytes:,} bytes, tile by tile {self.naive_bytes:,}"
        )


def report(expr: str, a: Tensor, b: Tensor, task_bytes: int = TASK_BYTES) -> Report:
    plan = parse(expr)
    shape = plan.shape_of_c(a.shape, b.shape)
    if TILES not in (a.form, b.form) or a.form != b.form:
        raise TensorDimsError("both operands must be in tiles")
    blocks = block_plan(plan, a, b, task_bytes)
    grid = dict(zip(plan.b, b.grid)) | dict(zip(plan.a, a.grid))
    count = lambda labels: prod(grid[x] for x in labels)
    c_bytes = prod(shape) * ELEMENT_BYTES[a.dtype]
    rows = [t.df.select(F.count("*").alias("n")).first()["n"] for t in (a, b)]
    return Report(
        blocks, (2 if a.dtype == "fp64" else 8) * prod(label_sizes(plan, a.shape, b.shape).values()), prod(a.grid), prod(b.grid), *rows,
        blocks.moved_bytes(a.dense_bytes, b.dense_bytes, c_bytes),
        a.dense_bytes * count(plan.free_b) + b.dense_bytes * count(plan.free_a),
    )
