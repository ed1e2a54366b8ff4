"""Contraction ``C = einsum(expr, A, B)`` of cells or of tiles.

Cells: equi-join on the contracted labels, product, grouped sum -- all in
Catalyst.  Tiles: a two-dimensional block plan.  C's tiles are divided into
``ga x gb`` groups by their free indices and the contracted tiles into ``gk``
slabs, so that what meets in one task (a band of A, a band of B) stays within
``task_bytes``; A goes to ``gb`` groups, B to ``ga``; the groups are joined by
cogroup and each multiplies with BLAS, one product per contracted tile.  Only
with more than one slab are partial tiles shuffled again and added up.

A pair of tiles is multiplied only if both are present, so an absent tile times
NaN is nothing, whereas a stored zero times NaN is NaN.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ravelgrid.errors import TensorTypeError
from ravelgrid.functions import index
from ravelgrid.functions.numbers import ELEMENT_BYTES, product, total
from ravelgrid.operators.tiles import add_up, retile, tile_rows, tile_schema, tile_table, to_tiles
from ravelgrid.plans.einsum import EinsumPlan, label_sizes, parse
from ravelgrid.sources.tensor import CELLS, TILES, Tensor

TASK_BYTES = 192 << 20
DEFAULT_TILE_BYTES = 2 << 20


def contract(
    expr: str | EinsumPlan, a: Tensor, b: Tensor, allow_batch: bool = False, strategy: str = "auto", task_bytes: int = TASK_BYTES
) -> Tensor:
    """The product as a tensor in the operands' form.

    ``strategy``: ``cells``, ``tiles``, or ``auto`` (tiles if an operand is in
    tiles, else cells).  The shape never decides: in tiles, cells that were
    absent are stored zeros and meet NaN as such, so tiles are the caller's choice.
    """
    plan = expr if isinstance(expr, EinsumPlan) else parse(expr, allow_batch)
    shape = plan.shape_of_c(a.shape, b.shape)
    if a.dtype != b.dtype:
        raise TensorTypeError(f"A is {a.dtype}, B is {b.dtype}")
    if strategy == "auto":
        strategy = TILES if TILES in (a.form, b.form) else CELLS
    if strategy == CELLS:
        return _contract_cells(plan, _cells(a), _cells(b), shape)
    if plan.batch or not shape:
        # batched and scalar results stay in cells
        return _contract_cells(plan, _cells(a), _cells(b), shape)
    return _contract_tiles(plan, *_same_tiles(plan, a, b), shape, task_bytes)


def _cells(t: Tensor) -> Tensor:
    from ravelgrid.operators.tiles import to_cells

    return t if t.form == CELLS else to_cells(t)


def _contract_cells(plan: EinsumPlan, a: Tensor, b: Tensor, shape) -> Tensor:
    left = a.df.select(*[F.col(f"i{d}").alias(f"l_{x}") for d, x in enumerate(plan.a)], F.col("v").alias("va"))
    right = b.df.select(*[F.col(f"i{d}").alias(f"{'r_' if x in plan.a else 'l_'}{x}") for d, x in enumerate(plan.b)], F.col("v").alias("vb"))
    shared = plan.contracted + plan.batch
    if shared:
        on = [F.col(f"l_{x}") == F.col(f"r_{x}") for x in shared]
        joined = left.join(right, on, "inner")
    else:
        # outer product: every pair is a cell of the result
        joined = left.crossJoin(right)
    keys = [F.col(f"l_{x}").alias(f"i{d}") for d, x in enumerate(plan.c)]
    pairs = joined.select(*keys, product(F.col("va"), F.col("vb"), a.dtype).alias("p"))
    names = [f"i{d}" for d in range(len(plan.c))]
    if not plan.contracted:
        return Tensor(pairs.withColumnRenamed("p", "v"), shape, a.dtype)
    summed = total(F.col("p"), a.dtype).alias("v")
    return Tensor(pairs.groupBy(*names).agg(summed) if names else pairs.agg(summed), shape, a.dtype)


def _same_tiles(plan: EinsumPlan, a: Tensor, b: Tensor) -> tuple[Tensor, Tensor]:
    """Both in tiles that agree on the contracted labels (B is cut anew where they do not)."""
    element = ELEMENT_BYTES[a.dtype]
    if a.form == CELLS:
        known = dict(zip(plan.b, b.chunk)) if b.chunk else {}
        side = max(1, int((DEFAULT_TILE_BYTES / element) ** (1 / a.rank)))
        a = to_tiles(a, [known.get(x, min(side, n)) if x in plan.contracted else min(side, n) for x, n in zip(plan.a, a.shape)])
    sides = {x: c for x, c in zip(plan.a, a.chunk) if x in plan.contracted}
    if b.form == CELLS:
        side = max(1, int((DEFAULT_TILE_BYTES / element) ** (1 / b.rank)))
        return a, to_tiles(b, [sides.get(x, min(side, n)) for x, n in zip(plan.b, b.shape)])
    return a, retile(b, [sides.get(x, c) for x, c in zip(plan.b, b.chunk)])


@dataclass(frozen=True)
class BlockPlan:
    """How many groups the free tiles of A and B and the contracted tiles are dealt to."""

    ga: int
    gb: int
    gk: int

    def moved_bytes(self, a_bytes: int, b_bytes: int, c_bytes: int) -> int:
        return a_bytes * self.gb + b_bytes * self.ga + (c_bytes * self.gk if self.gk > 1 else 0)


def choose_blocks(a_bytes: int, b_bytes: int, c_bytes: int, fa: int, fb: int, fk: int, task_bytes: int, parallel: int) -> BlockPlan:
    """The plan that moves the least among those whose tasks fit and keep ``parallel`` cores busy."""
    best, cost = None, None
    steps = lambda n: sorted({1, n, *(min(n, 2**e) for e in range(24))})
    wanted = min(parallel, fa * fb * fk)
    for ga in steps(fa):
        for gb in steps(fb):
            for gk in steps(fk):
                need = a_bytes / (ga * gk) + b_bytes / (gb * gk) + c_bytes / (ga * gb)
                plan = BlockPlan(ga, gb, gk)
                late = max(0.0, need / task_bytes - 1) * 1e6 + max(0.0, wanted / (ga * gb * gk) - 1)
                score = (late, plan.moved_bytes(a_bytes, b_bytes, c_bytes), ga * gb * gk)
                if cost is None or score < cost:
                    best, cost = plan, score
    return best


def block_plan(plan: EinsumPlan, a: Tensor, b: Tensor, task_bytes: int = TASK_BYTES) -> BlockPlan:
    """The block plan for operands whose tiles agree."""
    grid = dict(zip(plan.b, b.grid)) | dict(zip(plan.a, a.grid))
    tiles = lambda labels: prod(grid[x] for x in labels)
    c_bytes = prod(plan.shape_of_c(a.shape, b.shape)) * ELEMENT_BYTES[a.dtype]
    return choose_blocks(
        a.dense_bytes, b.dense_bytes, c_bytes, tiles(plan.free_a), tiles(plan.free_b), tiles(plan.contracted), task_bytes,
        a.df.sparkSession.sparkContext.defaultParallelism,
    )


def _contract_tiles(plan: EinsumPlan, a: Tensor, b: Tensor, shape, task_bytes: int) -> Tensor:
    chunk_of = dict(zip(plan.b, b.chunk)) | dict(zip(plan.a, a.chunk))
    size_of = label_sizes(plan, a.shape, b.shape)
    grid_of = {x: -(-size_of[x] // chunk_of[x]) for x in size_of}
    chunk_c = tuple(chunk_of[x] for x in plan.c)
    blocks = block_plan(plan, a, b, task_bytes)

    def number(labels: str, of: str):
        return index.flat_index([F.col(f"t{of.index(x)}") for x in labels], [grid_of[x] for x in labels])

    def deal(t: Tensor, labels: str, free: str, copies: int, own: int, names: tuple[str, str]):
        df = t.df.select(*t.keys, "data")
        mine = F.pmod(number(free, labels), F.lit(own)).cast("int")
        slab = F.pmod(number(plan.contracted, labels), F.lit(blocks.gk)).cast("int")
        df = df.withColumn(names[0], mine).withColumn("gk", slab)
        return df.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    left = deal(a, plan.a, plan.free_a, blocks.gb, blocks.ga, ("ga", "gb"))
    right = deal(b, plan.b, plan.free_b, blocks.ga, blocks.gb, ("gb", "ga"))
    rank_a, rank_b, dtype = a.rank, b.rank, a.dtype
    shape_a, shape_b, chunk_a, chunk_b = a.shape, b.shape, a.chunk, b.chunk
    where = {x: d for d, x in enumerate(plan.free_a + plan.free_b)}
    na, nk = len(plan.free_a), len(plan.contracted)

    def split(at, labels, names):
        return tuple(at[labels.index(x)] for x in names)

    def multiply(ta: pa.Table, tb: pa.Table) -> pa.Table:
        by_k: dict[tuple, tuple[list, list]] = {}
        for at, x in tile_rows(ta, rank_a, chunk_a, shape_a, dtype):
            by_k.setdefault(split(at, plan.a, plan.contracted), ([], []))[0].append((split(at, plan.a, plan.free_a), x.transpose(plan.perm_a)))
        for at, x in tile_rows(tb, rank_b, chunk_b, shape_b, dtype):
            if (k := split(at, plan.b, plan.contracted)) in by_k:
                by_k[k][1].append((split(at, plan.b, plan.free_b), x.transpose(plan.perm_b)))
        out: dict[tuple, np.ndarray] = {}
        ext_a, ext_b = {}, {}
        for xs, ys in by_k.values():
            if not xs or not ys:
                continue
            xs.sort(key=lambda p: p[0]), ys.sort(key=lambda p: p[0])
            for f, x in xs:
                ext_a[f] = x.shape[:na]
            for f, y in ys:
                ext_b[f] = y.shape[nk:]
            tall = np.concatenate([x.reshape(prod(x.shape[:na]), -1) for _, x in xs])
            wide = np.concatenate([y.reshape(prod(y.shape[:nk]), -1) for _, y in ys], axis=1)
            p = tall @ wide
            rows = np.cumsum([0, *(prod(ext_a[f]) for f, _ in xs)])
            cols = np.cumsum([0, *(prod(ext_b[f]) for f, _ in ys)])
            for i, (f, _) in enumerate(xs):
                for j, (g, _) in enumerate(ys):
                    part = p[rows[i] : rows[i + 1], cols[j] : cols[j + 1]]
                    if (f, g) in out:
                        out[f, g] += part
                    else:
                        out[f, g] = part.copy()
        result = []
        for (f, g), m in out.items():
            key = f + g
            cell = m.reshape(*ext_a[f], *ext_b[g]).transpose(plan.perm_c)
            result.append((tuple(key[where[x]] for x in plan.c), cell))
        return tile_table(result, len(plan.c)) if result else tile_table([], len(plan.c))

    keys = ["ga", "gb", "gk"]
    made = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(multiply, tile_schema(len(plan.c)))
    if blocks.gk > 1:
        made = add_up(made, len(plan.c), dtype)
    return Tensor(made, shape, dtype, chunk_c)

