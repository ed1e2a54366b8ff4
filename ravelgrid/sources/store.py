"""Tensors on storage: versioned Parquet tiles and a catalogue row per version.

``<path>/meta`` gets one appended row per committed version, ``<path>/v<n>``
holds that version's tiles.  A version becomes visible with its row, which
Spark's committer writes last, so a reader sees the old or the new one, and a
tensor can be written from a plan that reads it.
"""

from __future__ import annotations

import uuid
from math import prod

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelgrid.errors import TensorFileError
from ravelgrid.functions import index
from ravelgrid.functions.numbers import ELEMENT_BYTES, FP64, check_dtype
from ravelgrid.operators.tiles import tile_schema, to_tiles
from ravelgrid.plans.einsum import check_rank, chunk_shape
from ravelgrid.sources.tensor import CELLS, Tensor

META = "version long, shape array<long>, chunk array<long>, dtype string, folder string"
DEFAULT_BYTES = 16 << 20


class TileStore:
    """Create, fill, read, write and scan tensors below any path Spark can reach."""

    def __init__(self, spark: SparkSession, tile_bytes: int = DEFAULT_BYTES):
        self.spark, self.tile_bytes = spark, tile_bytes

    def _latest(self, path: str):
        try:
            row = self.spark.read.schema(META).parquet(f"{path}/meta").orderBy(F.desc("version")).first()
        except AnalysisException as e:
            raise TensorFileError(f"no tensor at {path}") from e
        if row is None:
            raise TensorFileError(f"no tensor at {path}")
        return row

    def exists(self, path: str) -> bool:
        try:
            self._latest(path)
        except TensorFileError:
            return False
        return True

    def _commit(self, path: str, tiles: DataFrame | None, shape, chunk, dtype) -> None:
        version = self._latest(path)["version"] + 1 if self.exists(path) else 0
        folder = f"v{version}-{uuid.uuid4().hex[:8]}"
        if tiles is None:
            tiles = self.spark.createDataFrame([], tile_schema(len(shape)))
        tiles.write.parquet(f"{path}/{folder}")
        row = [(version, list(shape), list(chunk), dtype, folder)]
        self.spark.createDataFrame(row, META).coalesce(1).write.mode("append").parquet(f"{path}/meta")

    def create(self, path: str, shape, dtype: str = FP64, chunk=None) -> Tensor:
        """An all-zero tensor without tiles; replaces what is there."""
        shape, dtype = check_rank(shape), check_dtype(dtype)
        chunk = tuple(chunk) if chunk else chunk_shape(shape, self.tile_bytes, ELEMENT_BYTES[dtype])
        self._commit(path, None, shape, tuple(min(c, n) for c, n in zip(chunk, shape)), dtype)
        return self.read(path)

    def fill(self, path: str, value: complex | float) -> Tensor:
        """Every cell gets ``value``; every tile is then present, also for zero."""
        import struct

        t = self.read(path)
        packed = struct.pack("<d", float(value)) if t.dtype == FP64 else struct.pack("<dd", complex(value).real, complex(value).imag)
        tiles = self.spark.range(prod(t.grid)).select(*[c.cast("int").alias(k) for c, k in zip(index.unravel(F.col("id"), t.grid), t.keys)])
        n = F.lit(1).cast("long")
        for k, c, s in zip(t.keys, t.chunk, t.shape):
            n = n * index.tile_extent(F.col(k), c, s)
        # the bytes are made in the JVM, from the repeated hexadecimal digits of one element
        data = F.unhex(F.repeat(F.lit(packed.hex()), n.cast("int")))
        self._commit(path, tiles.withColumn("data", data), t.shape, t.chunk, t.dtype)
        return self.read(path)

    def read(self, path: str) -> Tensor:
        row = self._latest(path)
        df = self.spark.read.schema(tile_schema(len(row["shape"]))).parquet(f"{path}/{row['folder']}")
        return Tensor(df, tuple(row["shape"]), row["dtype"], tuple(row["chunk"]))

    def write(self, path: str, t: Tensor, chunk=None) -> Tensor:
        """A new version from any tensor (cells are cut into tiles)."""
        shape = check_rank(t.shape)
        if t.form == CELLS:
            t = to_tiles(t, chunk or chunk_shape(shape, self.tile_bytes, ELEMENT_BYTES[t.dtype]))
        self._commit(path, t.df.select(*t.keys, "data"), shape, t.chunk, t.dtype)
        return self.read(path)

    def scan(self, path: str) -> DataFrame:
        """Keys of the present tiles with offset, extents and bytes; reads no more than it must."""
        t = self.read(path)
        return scan(t)


def scan(t: Tensor) -> DataFrame:
    keys = [F.col(k) for k in t.keys]
    offset = F.array(*[index.tile_offset(k, c) for k, c in zip(keys, t.chunk)])
    extent = F.array(*[index.tile_extent(k, c, n) for k, c, n in zip(keys, t.chunk, t.shape)])
    return t.df.select(*t.keys, offset.alias("offset"), extent.alias("extent"))


def lookup(t: Tensor, coords) -> DataFrame:
    """The tile at ``coords``: one row, or none if absent or out of range."""
    df = t.df
    for k, x in zip(t.keys, coords):
        df = df.filter(F.col(k) == F.lit(x))
    return df
