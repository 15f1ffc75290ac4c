"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import saved


def star_forest(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(node, root)`` for every node that is not the
    smallest of its component; ``root`` is that smallest node.

    Each round links every node's larger neighbours, then its smaller ones, to
    the smallest neighbour.  Rounds grow with the logarithm of the longest
    path.  Both steps are partial aggregations and equi-joins of narrow rows
    over freshly read tables, so that skewed nodes can be split at run time."""
    now = saved(edges.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
                .where("node <> root").distinct(), "edges")
    state = None
    for _ in range(max_rounds):
        both = now.union(now.select("root", "node"))
        low = both.groupBy("node").agg(F.least("node", F.min("root")).alias("low"))
        large = saved(both.withColumnRenamed("root", "other").where("other > node").join(low, "node")
                      .select(F.col("other").alias("node"), F.col("low").alias("root")).distinct(), "large")
        low = large.groupBy("node").agg(F.min("root").alias("low"))
        small = large.join(low, "node")
        now = saved(small.where("root <> low").select(F.col("root").alias("node"), F.col("low").alias("root"))
                    .union(low.select("node", F.col("low").alias("root"))).distinct(), "small")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()
        if seen == state:
            return now
        state = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
