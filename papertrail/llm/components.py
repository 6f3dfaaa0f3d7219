"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _both(e: DataFrame) -> DataFrame:
    return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest one around it."""
    both = _both(e)
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    j = both.join(least, "a").filter("b > a")
    return j.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every node's smaller neighbours and itself are tied to the smallest."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    j = down.join(least, "a")
    rest = j.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return rest.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges``: a, b (orderable, not null).  Returns node, comp, where comp
    is the smallest node of the component; every node of an edge appears.

    Edges only ever point to smaller nodes, so a round halves paths; groups
    are aggregated as (node, minimum) pairs and never collected.  Each round
    is cut by a checkpoint in the shared folder.
    """
    e = edges.select("a", "b").filter("a <> b").distinct().checkpoint()
    nodes = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node")))
    seen = None
    for _ in range(max_rounds):
        e = _small_star(_large_star(e)).checkpoint()
        state = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    down = e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"))
    return nodes.distinct().join(down, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
