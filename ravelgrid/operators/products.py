"""Fixed products, by their names."""

from __future__ import annotations

from ravelgrid.errors import TensorDimsError
from ravelgrid.operators.contract import contract
from ravelgrid.sources.tensor import Tensor


def matmul(a: Tensor, b: Tensor, **options) -> Tensor:
    """C(i,j) = sum_k A(i,k) B(k,j)."""
    if a.rank != 2 or b.rank != 2:
        raise TensorDimsError(f"matmul of ranks {a.rank} and {b.rank}")
    return contract("ik,kj->ij", a, b, **options)


def pair_product(a: Tensor, b: Tensor, **options) -> Tensor:
    """C(k,l,j,i) = sum_ab A(i,j,a,b) B(a,k,b,l)."""
    if a.rank != 4 or b.rank != 4:
        raise TensorDimsError(f"pair_product of ranks {a.rank} and {b.rank}")
    return contract("ijab,akbl->klji", a, b, **options)
