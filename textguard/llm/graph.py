"""Connected components of an edge table by alternating large-star and small-star steps.

Each step keeps for every node only its smallest neighbour and joins that back, so a hub's
neighbours are never gathered in one row; what is joined is materialised first, so that both sides
are plain shuffles and Spark can split a hub among tasks. The number of rounds grows with the logarithm of the
longest path. Every round is cut off in the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b): the smallest node reachable.

    Self-loops and repeated edges are allowed; nulls are dropped.
    """
    stars = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(max_rounds):
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        centre = checkpointed(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
        large = both.join(centre, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = checkpointed(large.where("a <> b").distinct())
        least = checkpointed(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        stars = checkpointed(small.where("a <> b").distinct())
        now = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"), F.count_distinct("a").alias("d")).first()
        if tuple(now) == state and now["n"] == now["d"]:
            break
        state = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    centres = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres)
