"""The registered tensor queries and their SQL.

Cells come from the relational tables: coordinates are keys modulo fixed
sizes, values are sums of whole numbers, so results are exact and shapes do not
depend on the scale.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelgrid.functions import index
from ravelgrid.operators.accumulate import accumulate, sum_of_products
from ravelgrid.operators.contract import contract
from ravelgrid.operators.tiles import retile, to_cells, to_tiles
from ravelgrid.sources.store import scan
from ravelgrid.sources.tensor import Tensor, from_dataframe, permute, to_dense

Query = Callable[[SparkSession, str], DataFrame]


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def _cells(df: DataFrame, coords: dict[str, tuple[str, int]], value: str = "l_quantity", dtype: str = "fp64") -> Tensor:
    """Cells from SQL expressions: label -> (expression, size)."""
    made = df.select(*[F.expr(f"cast({e} as bigint)").alias(x) for x, (e, _) in coords.items()], F.expr(value).alias("val"))
    return from_dataframe(made, list(coords), "val", [n for _, n in coords.values()], dtype)


def _ab(spark, sf_dir, where_a: str = "true", where_b: str = "true", rows: int = 48) -> tuple[Tensor, Tensor]:
    li = _lineitem(spark, sf_dir)
    a = _cells(li.filter(where_a), {"i": ("l_partkey % 48", rows), "j": ("l_suppkey % 40", 40)})
    b = _cells(li.filter(where_b), {"j": ("l_suppkey % 40", 40), "k": ("month(l_shipdate) - 1", 12)})
    return a, b


def _named(t: Tensor, labels: str) -> DataFrame:
    return t.df.select(*[F.col(f"i{d}").alias(x) for d, x in enumerate(labels)], "v")


_A = "SELECT CAST(l_partkey % 48 AS BIGINT) AS i, CAST(l_suppkey % 40 AS BIGINT) AS j, SUM(l_quantity) AS v FROM lineitem WHERE {} GROUP BY 1, 2"
_B = "SELECT CAST(l_suppkey % 40 AS BIGINT) AS j, CAST(month(l_shipdate) - 1 AS BIGINT) AS k, SUM(l_quantity) AS v FROM lineitem WHERE {} GROUP BY 1, 2"
_MATMUL = "SELECT a.i AS i, b.k AS k, CAST(SUM(a.v * b.v) AS DOUBLE) AS v FROM a JOIN b ON a.j = b.j GROUP BY 1, 2"


def _with(where_a: str = "true", where_b: str = "true") -> str:
    return f"WITH a AS ({_A.format(where_a)}), b AS ({_B.format(where_b)}) "


def contract_matmul(spark, sf_dir):
    return _named(contract("ij,jk->ik", *_ab(spark, sf_dir)), "ik")


def contract_transposed_out(spark, sf_dir):
    return _named(contract("ij,jk->ki", *_ab(spark, sf_dir)), "ki")


def _r3(li):
    a = _cells(li, {"a": ("l_partkey % 9", 9), "b": ("l_suppkey % 7", 7), "c": ("l_linenumber % 5", 5)})
    b = _cells(li, {"c": ("l_linenumber % 5", 5), "b": ("l_suppkey % 7", 7), "d": ("l_orderkey % 11", 11)})
    return a, b


def contract_rank3(spark, sf_dir):
    return _named(contract("abc,cbd->ad", *_r3(_lineitem(spark, sf_dir))), "ad")


_R3 = """WITH a AS (SELECT l_partkey % 9 AS a, l_suppkey % 7 AS b, l_linenumber % 5 AS c, SUM(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3),
b AS (SELECT l_linenumber % 5 AS c, l_suppkey % 7 AS b, l_orderkey % 11 AS d, SUM(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)
SELECT CAST(a.a AS BIGINT) AS a, CAST(b.d AS BIGINT) AS d, CAST(SUM(a.v * b.v) AS DOUBLE) AS v
FROM a JOIN b ON a.b = b.b AND a.c = b.c GROUP BY 1, 2"""


def _r4(li):
    a = _cells(li, {"i": ("l_orderkey % 8", 8), "j": ("l_partkey % 8", 8), "a": ("l_suppkey % 8", 8), "b": ("l_linenumber % 8", 8)})
    b = _cells(li, {"a": ("l_suppkey % 8", 8), "k": ("l_partkey % 8", 8), "b": ("l_linenumber % 8", 8), "l": ("l_orderkey % 8", 8)})
    return a, b


def contract_rank4(spark, sf_dir):
    return _named(contract("ijab,akbl->klji", *_r4(_lineitem(spark, sf_dir))), "klji")


def contract_rank4_tiled(spark, sf_dir):
    a, b = _r4(_lineitem(spark, sf_dir))
    made = contract("ijab,akbl->klji", to_tiles(a, (3, 3, 3, 3)), to_tiles(b, (3, 3, 3, 3)))
    return _named(to_cells(made), "klji").filter("v <> 0")


_R4 = """WITH a AS (SELECT l_orderkey % 8 AS i, l_partkey % 8 AS j, l_suppkey % 8 AS a, l_linenumber % 8 AS b, SUM(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4),
b AS (SELECT l_suppkey % 8 AS a, l_partkey % 8 AS k, l_linenumber % 8 AS b, l_orderkey % 8 AS l, SUM(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3, 4)
SELECT CAST(b.k AS BIGINT) AS k, CAST(b.l AS BIGINT) AS l, CAST(a.j AS BIGINT) AS j, CAST(a.i AS BIGINT) AS i, CAST(SUM(a.v * b.v) AS DOUBLE) AS v
FROM a JOIN b ON a.a = b.a AND a.b = b.b GROUP BY 1, 2, 3, 4"""


def contract_mixed_rank(spark, sf_dir):
    li = _lineitem(spark, sf_dir)
    a = _cells(li, {"a": ("l_orderkey % 4", 4), "b": ("l_partkey % 3", 3), "c": ("l_suppkey % 5", 5), "d": ("l_linenumber % 3", 3), "e": ("l_quantity % 6", 6)})
    b = _cells(li, {"c": ("l_suppkey % 5", 5), "f": ("l_orderkey % 6", 6), "e": ("l_quantity % 6", 6), "g": ("l_partkey % 4", 4)})
    return _named(contract("abcde,cfeg->abdfg", a, b), "abdfg")


_MIXED = """WITH a AS (SELECT l_orderkey % 4 AS a, l_partkey % 3 AS b, l_suppkey % 5 AS c, l_linenumber % 3 AS d, CAST(l_quantity AS BIGINT) % 6 AS e, SUM(l_quantity) AS v FROM lineitem GROUP BY ALL),
b AS (SELECT l_suppkey % 5 AS c, l_orderkey % 6 AS f, CAST(l_quantity AS BIGINT) % 6 AS e, l_partkey % 4 AS g, SUM(l_quantity) AS v FROM lineitem GROUP BY ALL)
SELECT CAST(a.a AS BIGINT) AS a, CAST(a.b AS BIGINT) AS b, CAST(a.d AS BIGINT) AS d, CAST(b.f AS BIGINT) AS f, CAST(b.g AS BIGINT) AS g, CAST(SUM(a.v * b.v) AS DOUBLE) AS v
FROM a JOIN b ON a.c = b.c AND a.e = b.e GROUP BY 1, 2, 3, 4, 5"""


def _complex_ab(spark, sf_dir):
    li = _lineitem(spark, sf_dir)
    value = "named_struct('r', l_quantity, 'i', cast(l_linenumber as double))"
    a = _cells(li, {"i": ("l_partkey % 48", 48), "j": ("l_suppkey % 40", 40)}, value, "complex128")
    b = _cells(li, {"j": ("l_suppkey % 40", 40), "k": ("month(l_shipdate) - 1", 12)}, value, "complex128")
    return a, b


def _flat(t: Tensor, labels: str) -> DataFrame:
    return t.df.select(*[F.col(f"i{d}").alias(x) for d, x in enumerate(labels)], F.col("v.r").alias("re"), F.col("v.i").alias("im"))


def contract_complex(spark, sf_dir):
    return _flat(contract("ij,jk->ik", *_complex_ab(spark, sf_dir)), "ik")


def contract_complex_tiled(spark, sf_dir):
    a, b = _complex_ab(spark, sf_dir)
    return _flat(to_cells(contract("ij,jk->ik", to_tiles(a, (13, 9)), to_tiles(b, (7, 5)))), "ik")


_COMPLEX = """WITH a AS (SELECT CAST(l_partkey % 48 AS BIGINT) AS i, l_suppkey % 40 AS j, SUM(l_quantity) AS r, SUM(CAST(l_linenumber AS DOUBLE)) AS m FROM lineitem GROUP BY 1, 2),
b AS (SELECT l_suppkey % 40 AS j, CAST(month(l_shipdate) - 1 AS BIGINT) AS k, SUM(l_quantity) AS r, SUM(CAST(l_linenumber AS DOUBLE)) AS m FROM lineitem GROUP BY 1, 2)
SELECT a.i AS i, b.k AS k, CAST(SUM(a.r * b.r - a.m * b.m) AS DOUBLE) AS re, CAST(SUM(a.r * b.m + a.m * b.r) AS DOUBLE) AS im
FROM a JOIN b ON a.j = b.j GROUP BY 1, 2"""


def _marginals(spark, sf_dir):
    li = _lineitem(spark, sf_dir)
    return _cells(li, {"i": ("l_partkey % 48", 48)}), _cells(li, {"j": ("l_suppkey % 40", 40)})


def contract_outer(spark, sf_dir):
    return _named(contract("i,j->ij", *_marginals(spark, sf_dir)), "ij")


_MARGINALS = """WITH x AS (SELECT CAST(l_partkey % 48 AS BIGINT) AS i, SUM(l_quantity) AS v FROM lineitem GROUP BY 1),
y AS (SELECT CAST(l_suppkey % 40 AS BIGINT) AS j, SUM(l_quantity) AS v FROM lineitem GROUP BY 1), """


def contract_vecmat(spark, sf_dir):
    x, _ = _marginals(spark, sf_dir)
    return _named(contract("i,ij->j", x, _ab(spark, sf_dir)[0]), "j")


def contract_inner(spark, sf_dir):
    a, _ = _ab(spark, sf_dir)
    return contract("ij,ij->", a, a).df


def contract_batch(spark, sf_dir):
    a, b = _r3(_lineitem(spark, sf_dir))
    # c is in A, B and C
    return _named(contract("abc,cbd->acd", a, b, allow_batch=True), "acd")


_BATCH = _R3.split("SELECT CAST(a.a")[0] + """SELECT CAST(a.a AS BIGINT) AS a, CAST(a.c AS BIGINT) AS c, CAST(b.d AS BIGINT) AS d, CAST(SUM(a.v * b.v) AS DOUBLE) AS v
FROM a JOIN b ON a.b = b.b AND a.c = b.c GROUP BY 1, 2, 3"""


def accumulate_two_terms(spark, sf_dir):
    c = contract("ij,jk->ik", *_ab(spark, sf_dir, "l_returnflag = 'A'"))
    return _named(accumulate("ij,jk->ik", *_ab(spark, sf_dir, "l_returnflag = 'N'"), c), "ik")


def accumulate_three_terms(spark, sf_dir):
    return _named(sum_of_products("ij,jk->ik", [_ab(spark, sf_dir, f"l_returnflag = '{f}'") for f in "ANR"]), "ik")


def accumulate_tiled(spark, sf_dir):
    terms = []
    for f in "ANR":
        a, b = _ab(spark, sf_dir, f"l_returnflag = '{f}'")
        terms.append((to_tiles(a, (10, 9)), to_tiles(b, (9, 4))))
    return _named(to_cells(sum_of_products("ij,jk->ik", terms)), "ik")


def contract_block_sparse(spark, sf_dir):
    """A keeps the tiles with even coordinate sum, B those with k tile 0."""
    a, b = _ab(spark, sf_dir)
    ta, tb = to_tiles(a, (16, 8)), to_tiles(b, (8, 6))
    ta, tb = ta.with_df(ta.df.filter("(t0 + t1) % 2 = 0")), tb.with_df(tb.df.filter("t1 = 0"))
    return _named(to_cells(contract("ij,jk->ik", ta, tb)), "ik").filter("v <> 0")


_SPARSE = _with() + """SELECT a.i AS i, b.k AS k, CAST(SUM(a.v * b.v) AS DOUBLE) AS v FROM a JOIN b ON a.j = b.j
WHERE (a.i // 16 + a.j // 8) % 2 = 0 AND b.k // 6 = 0 GROUP BY 1, 2"""


def contract_dense_output(spark, sf_dir):
    """A is taller than its cells reach: the rows of C beyond are zeros."""
    a, b = _ab(spark, sf_dir, rows=60)
    return _named(to_dense(contract("ij,jk->ik", a, b)), "ik")


_DENSE = _with() + f""", c AS ({_MATMUL})
SELECT CAST(g.i AS BIGINT) AS i, CAST(h.k AS BIGINT) AS k, COALESCE(c.v, 0.0::DOUBLE) AS v
FROM range(60) g(i) CROSS JOIN range(12) h(k) LEFT JOIN c ON c.i = g.i AND c.k = h.k"""


def tensor_fill(spark, sf_dir):
    """Cells of a constant tensor, through stored tiles with boundary tiles in every dimension."""
    from ravelgrid.sources.scratch import scratch_store

    store, path = scratch_store(spark)
    store.create(path, (25, 19, 13), chunk=(13, 8, 5))
    return _named(to_cells(store.fill(path, -2.0)), "ijk")


def tensor_create_scan(spark, sf_dir):
    """Tiles of a filled tensor with offsets and extents."""
    from ravelgrid.sources.scratch import scratch_store

    store, path = scratch_store(spark)
    store.create(path, (33, 27, 21, 15), chunk=(13, 13, 13, 13))
    store.fill(path, 1.0)
    long = lambda c: F.col(c).cast("long")
    out = store.scan(path)
    return out.select(*[long(f"t{d}").alias(f"t{d}") for d in range(4)], *[F.element_at("offset", d + 1).alias(f"o{d}") for d in range(4)],
                      *[F.element_at("extent", d + 1).cast("long").alias(f"e{d}") for d in range(4)])


_SCAN = "SELECT a.t AS t0, b.t AS t1, c.t AS t2, d.t AS t3, " + ", ".join(f"{x}.t * 13 AS o{k}" for k, x in enumerate("abcd")) + ", " + ", ".join(
    f"least(13, {n} - {x}.t * 13) AS e{k}" for k, (x, n) in enumerate(zip("abcd", (33, 27, 21, 15)))
) + " FROM range(3) a(t), range(3) b(t), range(2) c(t), range(2) d(t)"


def tile_scan(spark, sf_dir):
    """Present tiles and their sums, A cut into 16 x 8 tiles; the last rows of tiles are absent."""
    a, _ = _ab(spark, sf_dir, rows=80)
    t = to_tiles(a, (16, 8))
    cells = to_cells(t).df.withColumn("t0", index.tile_of(F.col("i0"), 16).cast("long")).withColumn("t1", index.tile_of(F.col("i1"), 8).cast("long"))
    present = scan(t).select(F.col("t0").cast("long").alias("t0"), F.col("t1").cast("long").alias("t1"))
    return present.join(cells.groupBy("t0", "t1").agg(F.sum("v").alias("v")), ["t0", "t1"])


_TILE_SCAN = f"SELECT i // 16 AS t0, j // 8 AS t1, SUM(v) AS v FROM ({_A.format('true')}) GROUP BY 1, 2"


def retile_cells(spark, sf_dir):
    """Cut anew from 7 x 11 to 16 x 8 and back to cells."""
    a, _ = _ab(spark, sf_dir)
    return _named(to_cells(retile(to_tiles(a, (7, 11)), (16, 8))), "ij").filter("v <> 0")


def permute_axes(spark, sf_dir):
    a, _ = _r3(_lineitem(spark, sf_dir))
    return _named(permute(a, (2, 0, 1)), "cab")


def permute_tiles(spark, sf_dir):
    a, _ = _r3(_lineitem(spark, sf_dir))
    return _named(to_cells(permute(to_tiles(a, (4, 3, 2)), (2, 0, 1))), "cab").filter("v <> 0")


_PERMUTE = "SELECT CAST(l_linenumber % 5 AS BIGINT) AS c, CAST(l_partkey % 9 AS BIGINT) AS a, CAST(l_suppkey % 7 AS BIGINT) AS b, SUM(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3"


def _embedding_cells(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cells = e.select((F.col("vec_id") % 64).alias("i"), F.posexplode("embedding").alias("d", "x"))
    made = cells.select("i", F.col("d").cast("long").alias("d"), F.round(F.col("x").cast("double") * 1000).alias("val"))
    return from_dataframe(made, ["i", "d"], "val", [64, 64])


def gram_embeddings(spark, sf_dir):
    a = _embedding_cells(spark, sf_dir)
    return _named(contract("id,jd->ij", a, a), "ij")


_GRAM = """WITH x AS (SELECT vec_id % 64 AS i, unnest(range(len(embedding))) AS d, unnest(embedding) AS x FROM embeddings),
a AS (SELECT i, d, SUM(round(CAST(x AS DOUBLE) * 1000)) AS v FROM x GROUP BY 1, 2)
SELECT CAST(a.i AS BIGINT) AS i, CAST(b.i AS BIGINT) AS j, CAST(SUM(a.v * b.v) AS DOUBLE) AS v FROM a JOIN a b ON a.d = b.d GROUP BY 1, 2"""


def events_product(spark, sf_dir):
    """Users by event types, times its transpose; type names are numbered in order."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    types = ["click", "purchase", "signup", "view", "other"]
    code = F.coalesce(F.array_position(F.array(*map(F.lit, types)), F.col("event_type")) - 1, F.lit(-1))
    code = F.when(code < 0, F.lit(4)).otherwise(code)
    made = ev.select((F.col("user_id") % 32).alias("u"), code.cast("long").alias("t"), F.floor("value").cast("double").alias("val"))
    a = from_dataframe(made, ["u", "t"], "val", [32, 5])
    return _named(contract("ut,wt->uw", a, a), "uw")


_EVENTS = """WITH a AS (SELECT user_id % 32 AS u, CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'view' THEN 3 ELSE 4 END AS t,
SUM(floor(value)) AS v FROM events WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2)
SELECT CAST(a.u AS BIGINT) AS u, CAST(b.u AS BIGINT) AS w, CAST(SUM(a.v * b.v) AS DOUBLE) AS v FROM a JOIN a b ON a.t = b.t GROUP BY 1, 2"""


def contract_matmul_tiled(spark, sf_dir):
    a, b = _ab(spark, sf_dir)
    # tile sides differ on j: B is cut anew
    return _named(to_cells(contract("ij,jk->ik", to_tiles(a, (16, 9)), to_tiles(b, (7, 5)))), "ik").filter("v <> 0")


def tensor_store_roundtrip(spark, sf_dir):
    """C = A B, then C += A B, through stored tensors and the engine."""
    from ravelgrid.engine import TensorEngine
    from ravelgrid.sources.scratch import scratch_store

    _, path = scratch_store(spark)
    eng = TensorEngine(spark)
    a, b = _ab(spark, sf_dir)
    eng.store.write(f"{path}/a", a, (16, 16))
    eng.store.write(f"{path}/b", b, (16, 6))
    eng.contract("ij,jk->ik", f"{path}/a", f"{path}/b", f"{path}/c")
    return _named(to_cells(eng.accumulate("ij,jk->ik", f"{path}/a", f"{path}/b", f"{path}/c")), "ik").filter("v <> 0")


def contract_whole_keys(spark, sf_dir):
    """Suppliers by months, over order and line: labels are the tables' own keys, cells as many as rows."""
    li = _lineitem(spark, sf_dir)
    size = li.agg(F.max("l_orderkey"), F.max("l_suppkey"), F.max("l_linenumber")).first()
    o, s, n = (int(x or 0) + 1 for x in size)
    a = _cells(li, {"s": ("l_suppkey", s), "o": ("l_orderkey", o), "n": ("l_linenumber", n)})
    b = _cells(li, {"o": ("l_orderkey", o), "n": ("l_linenumber", n), "m": ("month(l_shipdate) - 1", 12)})
    return _named(contract("son,onm->sm", a, b), "sm")


_WHOLE = """WITH a AS (SELECT l_suppkey AS s, l_orderkey AS o, l_linenumber AS n, SUM(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3),
b AS (SELECT l_orderkey AS o, l_linenumber AS n, CAST(month(l_shipdate) - 1 AS BIGINT) AS m, SUM(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3)
SELECT CAST(a.s AS BIGINT) AS s, b.m AS m, CAST(SUM(a.v * b.v) AS DOUBLE) AS v FROM a JOIN b ON a.o = b.o AND a.n = b.n GROUP BY 1, 2"""


def tensor_fill_complex(spark, sf_dir):
    """A stored complex tensor with its own chunk, filled and read back."""
    from ravelgrid.sources.scratch import scratch_store

    store, path = scratch_store(spark)
    store.create(path, (9, 7), "complex128", (4, 3))
    return _flat(to_cells(store.fill(path, 3 + 4j)), "ij")


def tensor_store_complex(spark, sf_dir):
    """C = A B of complex tensors, all three stored in tiles."""
    from ravelgrid.engine import TensorEngine
    from ravelgrid.sources.scratch import scratch_store

    _, path = scratch_store(spark)
    eng = TensorEngine(spark)
    a, b = _complex_ab(spark, sf_dir)
    eng.store.write(f"{path}/a", a, (16, 16))
    eng.store.write(f"{path}/b", b, (16, 6))
    return _flat(to_cells(eng.contract("ij,jk->ik", f"{path}/a", f"{path}/b", f"{path}/c")), "ik").filter("re <> 0 or im <> 0")


def tensor_create_bytes(spark, sf_dir):
    """Chunks chosen by a target of bytes, on storage and read back."""
    from ravelgrid.sources.scratch import scratch_store
    from ravelgrid.sources.store import TileStore

    rows = []
    for target in (64 << 10, 4 << 20):
        _, path = scratch_store(spark)
        t = TileStore(spark, target).create(path, (200, 200))
        rows.append((target, *t.chunk, t.df.count()))
    return spark.createDataFrame(rows, "target long, c0 long, c1 long, present long")


def tile_lookup(spark, sf_dir):
    """Three tiles of a sparse tensor: two present, one absent, and one beyond its grid."""
    from ravelgrid.sources.store import lookup

    cells = spark.range(3).select(*[(F.col("id") * 64).alias(x) for x in "ijk"], (F.col("id") + 1).cast("double").alias("val"))
    t = to_tiles(from_dataframe(cells, list("ijk"), "val", [192, 192, 192]), (64, 64, 64))
    asked = [(0, 0, 0), (1, 1, 1), (0, 1, 0), (9, 9, 9)]
    found = [lookup(t, at).select(*[F.lit(x).cast("long").alias(f"t{d}") for d, x in enumerate(at)], F.octet_length("data").cast("long").alias("bytes")) for at in asked]
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def permute_identity(spark, sf_dir):
    a, _ = _r3(_lineitem(spark, sf_dir))
    return _named(to_cells(permute(to_tiles(a, (4, 3, 2)), (0, 1, 2))), "abc").filter("v <> 0")


_IDENTITY = "SELECT CAST(l_partkey % 9 AS BIGINT) AS a, CAST(l_suppkey % 7 AS BIGINT) AS b, CAST(l_linenumber % 5 AS BIGINT) AS c, SUM(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3"


def plan_and_report(spark, sf_dir):
    """The text of a plan, and what the tiled product has to read and compute."""
    from ravelgrid.plans.einsum import parse
    from ravelgrid.plans.report import report

    a, b = _ab(spark, sf_dir, rows=80)
    r = report("ij,jk->ik", to_tiles(a, (16, 8)), to_tiles(b, (8, 6)))
    row = (str(parse("ij,jk->ik")), r.flops, r.tiles_a, r.tiles_b, r.present_a, r.present_b)
    return spark.createDataFrame([row], "plan string, flops long, tiles_a long, tiles_b long, present_a long, present_b long")


_REPORT = _with() + """SELECT 'ij,jk->ik: free A i, free B k, contracted j' AS plan, CAST(2 * 80 * 40 * 12 AS BIGINT) AS flops, CAST(25 AS BIGINT) AS tiles_a,
CAST(10 AS BIGINT) AS tiles_b, (SELECT COUNT(DISTINCT (i // 16, j // 8)) FROM a) AS present_a, (SELECT COUNT(DISTINCT (j // 8, k // 6)) FROM b) AS present_b"""


def error_codes(spark, sf_dir):
    """What the engine raises for wrong calls, as codes."""
    from ravelgrid.engine import TensorEngine
    from ravelgrid.errors import TensorError, code_of, describe
    from ravelgrid.plans.einsum import parse
    from ravelgrid.sources.scratch import scratch_store

    _, path = scratch_store(spark)
    eng = TensorEngine(spark)
    eng.create(f"{path}/a", (2, 3))
    eng.create(f"{path}/b", (4, 2))
    calls = {
        "missing": lambda: eng.read(f"{path}/none"), "shapes": lambda: eng.contract("ij,jk->ik", f"{path}/a", f"{path}/b", f"{path}/c"),
        "expression": lambda: parse("ij->ij"), "fine": lambda: parse("ij,jk->ik"),
    }
    rows = []
    for name, call in calls.items():
        raised = None
        try:
            call()
        except TensorError as e:
            raised = e
        rows.append((name, code_of(raised), describe(code_of(raised))))
    return spark.createDataFrame(rows, "call string, code long, meaning string")


def queries() -> dict[str, Query]:
    found = [
        contract_matmul, contract_transposed_out, contract_rank3, contract_rank4, contract_rank4_tiled, contract_mixed_rank, contract_complex,
        contract_complex_tiled, contract_outer, contract_vecmat, contract_inner, contract_batch, accumulate_two_terms, accumulate_three_terms,
        accumulate_tiled, contract_block_sparse, contract_dense_output, tensor_fill, tensor_create_scan, tile_scan, retile_cells, permute_axes,
        permute_tiles, gram_embeddings, events_product, contract_matmul_tiled, tensor_store_roundtrip,
        contract_whole_keys, tensor_fill_complex, tensor_store_complex, tensor_create_bytes, tile_lookup, permute_identity, plan_and_report,
        error_codes,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    two = (
        "WITH a1 AS ({a1}), b AS ({b}), a2 AS ({a2}), p AS (SELECT a1.i, b.k, a1.v * b.v AS v FROM a1 JOIN b ON a1.j = b.j "
        "UNION ALL SELECT a2.i, b.k, a2.v * b.v AS v FROM a2 JOIN b ON a2.j = b.j) SELECT i, k, CAST(SUM(v) AS DOUBLE) AS v FROM p GROUP BY 1, 2"
    ).format(a1=_A.format("l_returnflag = 'A'"), a2=_A.format("l_returnflag = 'N'"), b=_B.format("true"))
    three = _with("l_returnflag IN ('A', 'N', 'R')") + _MATMUL
    nonzero = f"SELECT * FROM ({{}}) WHERE v <> 0"
    return {
        "contract_matmul": _with() + _MATMUL,
        "contract_transposed_out": _with() + _MATMUL,
        "contract_rank3": _R3,
        "contract_rank4": _R4,
        "contract_rank4_tiled": nonzero.format(_R4),
        "contract_mixed_rank": _MIXED,
        "contract_complex": _COMPLEX,
        "contract_complex_tiled": _COMPLEX,
        "contract_outer": _MARGINALS.rstrip(", ") + " SELECT i, j, CAST(x.v * y.v AS DOUBLE) AS v FROM x CROSS JOIN y",
        "contract_vecmat": _MARGINALS + f"a AS ({_A.format('true')}) SELECT a.j AS j, CAST(SUM(x.v * a.v) AS DOUBLE) AS v FROM x JOIN a ON x.i = a.i GROUP BY 1",
        "contract_inner": f"SELECT CAST(COALESCE(SUM(v * v), 0) AS DOUBLE) AS v FROM ({_A.format('true')})",
        "contract_batch": _BATCH,
        "accumulate_two_terms": two,
        "accumulate_three_terms": three,
        "accumulate_tiled": three,
        "contract_block_sparse": nonzero.format(_SPARSE),
        "contract_dense_output": _DENSE,
        "tensor_fill": "SELECT a.i AS i, b.j AS j, c.k AS k, CAST(-2.0 AS DOUBLE) AS v FROM range(25) a(i), range(19) b(j), range(13) c(k)",
        "tensor_create_scan": _SCAN,
        "tile_scan": _TILE_SCAN,
        "retile_cells": f"SELECT i, j, v FROM ({_A.format('true')}) WHERE v <> 0",
        "permute_axes": _PERMUTE,
        "permute_tiles": nonzero.format(_PERMUTE),
        "gram_embeddings": _GRAM,
        "events_product": _EVENTS,
        "contract_matmul_tiled": nonzero.format(_with() + _MATMUL),
        "tensor_store_roundtrip": _with() + "SELECT a.i AS i, b.k AS k, CAST(2 * SUM(a.v * b.v) AS DOUBLE) AS v FROM a JOIN b ON a.j = b.j GROUP BY 1, 2",
        "contract_whole_keys": _WHOLE,
        "tensor_fill_complex": "SELECT a.i AS i, b.j AS j, CAST(3 AS DOUBLE) AS re, CAST(4 AS DOUBLE) AS im FROM range(9) a(i), range(7) b(j)",
        "tensor_store_complex": _COMPLEX,
        "tensor_create_bytes": "SELECT * FROM (VALUES (65536::BIGINT, 91::BIGINT, 91::BIGINT, 0::BIGINT), (4194304, 200, 200, 0)) t(target, c0, c1, present)",
        "tile_lookup": "SELECT i AS t0, i AS t1, i AS t2, CAST(64 * 64 * 64 * 8 AS BIGINT) AS bytes FROM range(2) r(i)",
        "permute_identity": nonzero.format(_IDENTITY),
        "plan_and_report": _REPORT,
        "error_codes": "SELECT * FROM (VALUES ('missing', -1::BIGINT, 'file error'), ('shapes', -2, 'incompatible dimensions'), "
        "('expression', -3, 'bad expression'), ('fine', 0, 'ok')) t(call, code, meaning)",
    }
