"""Connected components of an undirected graph, by alternating large-star and small-star steps.

Each step is one aggregation and one join on the edge table; the edge table is written to the shared
folder after each round, so lineage stays short and nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vouchwell.llm._shared import materialize

#: Far above the logarithmic number of rounds; reached only if a step were not monotone.
MAX_ROUNDS = 60


def _star(arcs: DataFrame, larger_only: bool) -> DataFrame:
    """For every node u of arcs (u, v): link its neighbours to the least of u and them."""
    least = arcs.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).withColumn("m", F.least("m", "c"))
    hung = arcs.join(least, arcs["u"] == least["c"])
    if larger_only:
        return hung.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.filter("m < c").select(F.col("c").alias("u"), F.col("m").alias("v"))
    return hung.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: columns a, b (long). Returns (node, root) for every node whose component has a
    smaller node; root is the component's least node. Loops and repeated edges are allowed."""
    down = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    down = materialize(down, "edges")
    for _ in range(MAX_ROUNDS):
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, larger_only=True).distinct()
        new = materialize(_star(large, larger_only=False).distinct(), "edges")
        # Stars: no node hangs on two others, and no centre hangs on any.
        many = new.groupBy("u").count().filter("count > 1").limit(1).count()
        if not many and not new.join(new.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count():
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        down = new
    raise RuntimeError("connected components did not settle")
