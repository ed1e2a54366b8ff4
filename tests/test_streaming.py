import numpy as np
import pytest

from ravelgrid.sources.tensor import from_numpy
from ravelgrid.streaming.products import running_contract


def test_running_product_follows_the_stream(spark, tmp_path):
    rng = np.random.default_rng(2)
    a, b = rng.integers(-5, 6, (4, 5)) * 1.0, rng.integers(-5, 6, (5, 3)) * 1.0
    cells = [(i, j, float(a[i, j])) for i in range(4) for j in range(5)]
    schema = "i0 long, i1 long, v double"
    for n, part in enumerate((cells[:8], cells[8:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = running_contract("ij,jk->ik", stream, (4, 5), from_numpy(spark, b))
    q = out.writeStream.format("memory").queryName("running").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = np.zeros((4, 3))
    for r in spark.sql("SELECT * FROM running").collect():
        got[r.i0, r.i1] = r.v
    assert np.array_equal(got, a @ b)
    with pytest.raises(ValueError):
        running_contract("ij,jk->ik", spark.createDataFrame(cells, schema), (4, 5), from_numpy(spark, b))
