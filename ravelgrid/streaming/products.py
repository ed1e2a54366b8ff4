"""Products that follow a stream of cells.

``einsum`` is linear in each operand, so the product with a fixed B can be kept
current while cells of A arrive: each arriving cell contributes its products,
and the running sums per cell of C are Spark's state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelgrid.operators.contract import contract
from ravelgrid.sources.tensor import Tensor


def running_contract(expr: str, stream: DataFrame, shape, b: Tensor, dtype: str = "fp64") -> DataFrame:
    """Streaming cells of A (``i0.., v``; repeats add up) times the fixed cells of B.

    Write the result in ``update`` or ``complete`` mode.
    """
    if not stream.isStreaming:
        raise ValueError("A is not a stream")
    clean = stream.filter(F.col("v").isNotNull())
    return contract(expr, Tensor(clean, tuple(shape), dtype), b, strategy="cells").df
