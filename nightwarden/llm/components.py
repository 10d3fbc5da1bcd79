"""Connected components of a link table, by alternating star contraction on joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

MAX_ROUNDS = 64


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node reachable.

    Each round hangs all larger neighbours of a node on its smallest neighbour, then all smaller ones, so the number of
    rounds grows with the logarithm of the longest path. Rounds are written and read back; the end is found by count
    and a combined hash of the rows. Null nodes and links of a node to itself are left out. Hot nodes are joined, never
    gathered.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges, seen = cut_lineage(edges), None
    for _ in range(MAX_ROUNDS):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = cut_lineage(small.unionAll(least.withColumnRenamed("m", "v")).distinct())
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            tops = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(tops)
        seen = state
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
