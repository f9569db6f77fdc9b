"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps.

Every step is a shuffle of the edges with a minimum per node; hot nodes are combined before the shuffle and their rows are
split by the skew join. Each round is written to the shared folder, the last but one is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node with an edge; the root is the smallest node of its component.

    ``edges`` has two columns ``u, v`` of long; loops, repeats and nulls are left out. Runs one job per round.
    """
    now = scratch.write(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    state = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(floor.select("u", F.col("m").alias("v"))).distinct()
        then = scratch.write(small)
        scratch.drop(now)
        now = then
        after = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).collect()[0]
        if tuple(after) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = tuple(after)
    raise RuntimeError(f"no stable components after {rounds} rounds")
