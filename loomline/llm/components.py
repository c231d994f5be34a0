"""Connected components by alternating star contractions, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.session import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node around it."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("w")).withColumn("m", F.least("u", "w")).select("u", "m")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).where("u <> v").distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(id, root) for every node of the edges (u, v), two longs; the root is the smallest id of the component.

    Each round is two joins whose state is as large as the edges, and the number
    of rounds grows with the logarithm of the component size. Every round is
    checkpointed, so that lost executors cost one round. Self-loops and null
    ends are left out; repeated edges count once.
    """
    now = checkpointed(edges.select("u", "v").where("u <> v").distinct())
    state = None
    for _ in range(most_rounds):
        now = checkpointed(_small_star(_large_star(now)))
        row = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == (row["n"], row["x"]):
            break
        state = (row["n"], row["x"])
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return stars.union(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
