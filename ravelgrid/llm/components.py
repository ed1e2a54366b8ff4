"""Connected components by contraction, as joins and grouped aggregates.

Each round every node points to the neighbour (or itself) with the smallest
round-dependent hash, the graph is contracted along those pointers, and the
mapping is written to the shared folder.  Hashing anew each round makes the
expected number of nodes with edges fall by a constant factor, whatever the
shape of the graph.  No step sees a whole component in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravelgrid.llm.common import materialize


def connected(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of any one type to (node, rep): one rep per component.

    Nodes without edges do not appear; self-loops and repeats do no harm.
    """
    live = materialize(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    mapping = None
    rounds = 0
    while not live.isEmpty():
        both = live.union(live.select(F.col("b"), F.col("a"))).toDF("node", "other")
        order = F.struct(F.xxhash64("other", F.lit(rounds)).alias("h"), F.col("other").alias("o"))
        best = both.groupBy("node").agg(F.min(order).alias("m"))
        own = F.struct(F.xxhash64("node", F.lit(rounds)).alias("h"), F.col("node").alias("o"))
        step = materialize(best.select("node", F.least(F.col("m"), own)["o"].alias("to")), "pointers")
        if mapping is None:
            mapping = step.withColumnRenamed("to", "rep")
        else:
            moved = step.withColumnRenamed("node", "rep")
            mapping = materialize(
                mapping.join(moved, "rep", "left").select("node", F.coalesce("to", "rep").alias("rep")), "mapping"
            )
        left = step.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        right = step.select(F.col("node").alias("b"), F.col("to").alias("rb"))
        live = materialize(
            live.join(left, "a").join(right, "b").filter("ra <> rb")
            .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(),
            "edges",
        )
        rounds += 1
    return live.toDF("node", "rep") if mapping is None else mapping
