"""Connected components by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins over the edges; labels and edges
stay distributed, and only one count and one checksum a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import materialise


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(a, b)``, any orientation -> ``(id, component)`` for every id on an edge.

    ``component`` is the smallest id that can be reached. Loops, repeated edges
    and null ends are ignored; an empty input gives an empty result.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(now)
    before = _sum(now)
    if not before[0]:
        return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    for _ in range(rounds):
        # large star: every larger neighbour is tied to the node's smallest one
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: smaller neighbours and the node itself are tied to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = materialise(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        after = _sum(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).transform(
        lambda x: x.unionByName(x.select(F.col("component").alias("id"), "component").distinct())
    )
