"""Products and sums of cells, real or complex, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ravelgrid.errors import TensorTypeError

FP64, COMPLEX128 = "fp64", "complex128"
ELEMENT_BYTES = {FP64: 8, COMPLEX128: 16}


def check_dtype(dtype: str) -> str:
    if dtype not in ELEMENT_BYTES:
        raise TensorTypeError(f"element type {dtype!r} is neither {FP64} nor {COMPLEX128}")
    return dtype


def product(a: Column, b: Column, dtype: str) -> Column:
    """a times b; complex numbers are not conjugated."""
    if dtype == FP64:
        return a * b
    return F.struct((a["r"] * b["r"] - a["i"] * b["i"]).alias("r"), (a["r"] * b["i"] + a["i"] * b["r"]).alias("i"))


def total(v: Column, dtype: str) -> Column:
    """Aggregate: the sum; of no rows, zero."""
    zero = F.lit(0.0)
    if dtype == FP64:
        return F.coalesce(F.sum(v), zero)
    return F.struct(F.coalesce(F.sum(v["r"]), zero).alias("r"), F.coalesce(F.sum(v["i"]), zero).alias("i"))


def zero_of(dtype: str) -> Column:
    return F.lit(0.0) if dtype == FP64 else F.struct(F.lit(0.0).alias("r"), F.lit(0.0).alias("i"))
