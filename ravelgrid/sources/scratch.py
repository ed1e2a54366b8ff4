"""A place for tensors that queries make on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from ravelgrid.errors import TensorFileError
from ravelgrid.sources.store import TileStore

_own: str | None = None


def scratch_store(spark: SparkSession) -> tuple[TileStore, str]:
    """A store and a new path below spark.checkpoint.dir (a folder of our own only where it is unset and all run in one process)."""
    global _own
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise TensorFileError("on a cluster spark.checkpoint.dir must name a folder that the driver and all executors share")
        _own = _own or "file://" + tempfile.mkdtemp(prefix="ravelgrid-tensors-")
        top = _own
    return TileStore(spark), f"{top.rstrip('/')}/tensor-{uuid.uuid4().hex}"
