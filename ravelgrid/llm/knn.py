"""Exact top-k inner-product search as a Voronoi kNN join (operator 8).

Largest inner product becomes nearest neighbour by one more component
(``sqrt(M^2 - |x|^2)`` for data, 0 for queries, ``M`` the largest norm).  Data
are assigned to their nearest pivot; a cell's summary holds its distances'
range and its k+1 smallest distances.  Queries are grouped by pivot, cells of
queries into groups of ``group_queries``.  From the summaries follows for each
query cell a distance within which its k+1 nearest rows must lie; a data row is
replicated to a query group only if the triangle inequality lets it come that
near.  Groups are solved locally, block against block; partial lists meet by
query.  Pivots, their distances and summaries are bounded by ``pivots``; data
of a group are dealt over salts, so one crowded cell or group is no one task.

Arithmetic is exact: products are computed in doubles only where the norms
prove every partial sum below 2**53, else in Python integers (clipped to the
range of a long).

Defined results: vectors that are null, empty or hold null or non-finite
components, and null ids, take no part.  Shorter vectors count as padded with
zeros.  Rows that share an id are different rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ravelgrid.llm.common import materialize, shuffle_partitions

K = 10
PIVOTS = 64
GROUP_QUERIES = 2048
BLOCK_ROWS = 1024
SCALE = 1024
_SLACK = 1e-7
HIT_SCHEMA = "q_uid long, query_id long, vec_id long, uid long, score long"


def _matrix(column, dim: int) -> np.ndarray:
    """A list column as rows of doubles, padded with zeros."""
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    ends = np.cumsum(sizes)
    for i, (e, n) in enumerate(zip(ends, sizes)):
        out[i, :n] = flat[e - n : e]
    return out


def _to_pivots(x: np.ndarray, last: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of the lengthened rows to the (lengthened) pivots."""
    sq = (x * x).sum(1) + last * last
    d2 = sq[:, None] - 2 * (x @ pivots[:, :-1].T + last[:, None] * pivots[None, :, -1]) + (pivots * pivots).sum(1)[None, :]
    return np.sqrt(np.maximum(d2, 0))


class Cells:
    """Pivots and what follows from the summaries; of bounded size."""

    def __init__(self, pivots: np.ndarray, top: float, dim: int):
        self.pivots, self.top, self.dim = pivots, top, dim
        p2 = (pivots * pivots).sum(1)
        self.between = np.sqrt(np.maximum(p2[:, None] + p2[None, :] - 2 * pivots @ pivots.T, 0))
        self.slack = _SLACK * (1 + top * 2)

    def assign(self, x: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        last = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.top**2 - (x * x).sum(1), 0))
        d = _to_pivots(x, last, self.pivots)
        cell = d.argmin(1)
        return cell, d[np.arange(len(x)), cell]

    def bound(self, k: int, nearest: dict[int, list[float]], reach: dict[int, float], counts: dict[int, int], per_group: int):
        """Radius per query cell, and query cells gathered into groups."""
        self.radius = {}
        for c, far in reach.items():
            ways = sorted(far + self.between[c, j] + d for j, ds in nearest.items() for d in ds)
            self.radius[c] = ways[k] if len(ways) > k else np.inf
        self.reach = reach
        self.group_of, group, filled, left = {}, 0, 0, set(reach)
        at = min(left, default=None)
        while left:
            if filled and filled + counts[at] > per_group:
                group, filled = group + 1, 0
            self.group_of[at] = group
            filled += counts[at]
            left.discard(at)
            at = min(left, key=lambda c: (self.between[at, c], c), default=None)
        self.groups = group + 1

    def wanted(self, cell: np.ndarray, dist: np.ndarray) -> np.ndarray:
        """Rows x groups: may the row be among the k+1 nearest of a query of the group?"""
        out = np.zeros((len(cell), self.groups), bool)
        for c, g in self.group_of.items():
            gap = self.between[c, cell]
            low = np.maximum(gap - dist, dist - gap) - self.reach[c]
            out[:, g] |= low <= self.radius[c] + self.slack
        return out


def _blocks(cells: Cells, salts: int):
    def run(batches):
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId() * 7919
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                uid, vid = part.column(0).to_numpy(), part.column(1).to_numpy()
                x = _matrix(part.column(2), cells.dim)
                want = cells.wanted(*cells.assign(x, query=False))
                rows = []
                for g in np.flatnonzero(want.any(axis=0)):
                    m = want[:, g]
                    rows.append((int(g), turn % salts, uid[m].tobytes(), vid[m].tobytes(), x[m].tobytes()))
                turn += 1
                if rows:
                    types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                    yield pa.record_batch(
                        [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["grp", "salt", "uids", "vids", "data"]
                    )

    return run


def _query_blocks(cells: Cells):
    def run(batches):
        for batch in batches:
            uid, vid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = _matrix(batch.column(2), cells.dim)
            cell, _ = cells.assign(x, query=True)
            group = np.array([cells.group_of[c] for c in cell.tolist()], np.int64)
            rows = []
            for g in np.unique(group):
                for at in np.array_split(np.flatnonzero(group == g), -(-int((group == g).sum()) // BLOCK_ROWS)):
                    rows.append((int(g), uid[at].tobytes(), vid[at].tobytes(), x[at].tobytes()))
            if rows:
                types = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["grp", "q_uids", "q_vids", "q_data"]
                )

    return run


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    most = np.sqrt((q * q).sum(1).max() * (x * x).sum(1).max())
    if most < 2.0**52:
        return (q @ x.T).astype(np.int64)
    whole = [[int(c) for c in row] for row in x]
    ends = (-(2**63), 2**63 - 1)
    return np.array(
        [[min(max(sum(a * b for a, b in zip(map(int, r), w)), ends[0]), ends[1]) for w in whole] for r in q], np.int64
    )


def _solve(dim: int, k: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                quid, qid = np.frombuffer(row["q_uids"], np.int64), np.frombuffer(row["q_vids"], np.int64)
                uid, vid = np.frombuffer(row["uids"], np.int64), np.frombuffer(row["vids"], np.int64)
                q, x = np.frombuffer(row["q_data"]).reshape(-1, dim), np.frombuffer(row["data"]).reshape(-1, dim)
                by_id = np.argsort(vid, kind="stable")
                uid, vid, x = uid[by_id], vid[by_id], x[by_id]
                score = _products(q, x)
                order = np.argsort(-score, axis=1, kind="stable")[:, : k + 1]  # stable: ties to smaller ids
                at = np.repeat(np.arange(len(q)), order.shape[1])
                to = order.reshape(-1)
                other = uid[to] != quid[at]
                at, to = at[other], to[other]
                yield pa.record_batch(
                    [pa.array(quid[at]), pa.array(qid[at]), pa.array(vid[to]), pa.array(uid[to]), pa.array(score[at, to])],
                    names=["q_uid", "query_id", "vec_id", "uid", "score"],
                )

    return run


def _floor(c):
    y = c * SCALE
    return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)  # beyond, doubles are whole


def top_k(vectors: DataFrame, k: int = K, every: int = 100, pivots: int = PIVOTS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest products of each row whose id ``every`` divides, over all other rows."""
    spark = vectors.sparkSession
    number = F.col("embedding").cast("array<double>")
    fine = F.forall(number, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    whole = F.transform(number, _floor)
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    data = materialize(rows, "vectors")
    square = F.expr("aggregate(v, 0D, (a, c) -> a + c * c)")
    dim, top, n = data.agg(F.max(F.size("v")), F.max(square), F.count("*")).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n:
        return empty
    picked = data.orderBy(F.xxhash64("vec_id"), "uid").limit(min(pivots, n)).select("v").collect()
    raw = np.zeros((len(picked), dim))
    for i, r in enumerate(picked):
        raw[i, : len(r["v"])] = r["v"]
    top = float(np.sqrt(top)) * (1 + 1e-12)
    last = np.sqrt(np.maximum(top**2 - (raw * raw).sum(1), 0))
    cells = Cells(np.unique(np.hstack([raw, last[:, None]]), axis=0), top, dim)

    def summarize(batches):
        for batch in batches:
            is_query = batch.column(1).to_numpy() % every == 0
            x = _matrix(batch.column(2), dim)
            cell, dist = cells.assign(x, query=False)
            q_cell, q_dist = cells.assign(x[is_query], query=True)
            near = [(int(c), False, float(d)) for c in np.unique(cell) for d in np.sort(dist[cell == c])[: k + 1]]
            far = [(int(c), True, float(d)) for c, d in zip(q_cell, q_dist)]
            cols = list(zip(*(near + far)))
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.bool_(), pa.float64()))], names=["cell", "query", "dist"]
            )

    seen = data.mapInArrow(summarize, "cell int, query boolean, dist double")
    smallest = Window.partitionBy("cell").orderBy("dist")
    near = seen.filter("not query").withColumn("r", F.row_number().over(smallest)).filter(F.col("r") <= k + 1)
    nearest: dict[int, list[float]] = {}
    for r in near.select("cell", "dist").collect():
        nearest.setdefault(r["cell"], []).append(r["dist"])
    asked = seen.filter("query").groupBy("cell").agg(F.max("dist").alias("far"), F.count("*").alias("n")).collect()
    if not asked:
        return empty
    cells.bound(k, nearest, {r["cell"]: r["far"] for r in asked}, {r["cell"]: r["n"] for r in asked}, group_queries)
    salts = max(1, min(4 * shuffle_partitions(spark), -(-n // BLOCK_ROWS)))
    blocks = data.mapInArrow(_blocks(cells, salts), "grp int, salt int, uids binary, vids binary, data binary")
    # queries packed by their group, one copy per salt of the group
    queries = data.filter(F.col("vec_id") % every == 0).mapInArrow(
        _query_blocks(cells), "grp int, q_uids binary, q_vids binary, q_data binary"
    )
    copies = queries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hits = blocks.join(copies, ["grp", "salt"]).select("q_uids", "q_vids", "q_data", "uids", "vids", "data").mapInArrow(
        _solve(dim, k), HIT_SCHEMA
    )
    best = Window.partitionBy("q_uid").orderBy(F.desc("score"), "vec_id", "uid")
    return (
        hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
