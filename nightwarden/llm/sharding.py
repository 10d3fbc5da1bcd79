"""A uniform random shuffle into shards of exact sizes, by a communication matrix.

Rows are dealt into blocks by a hash of their keys and of all columns, so rows of one key are spread. How many rows of
each block go to each shard is drawn from the multivariate hypergeometric distribution, block after block, which is how a
uniform permutation would fall; the matrix has blocks x shards numbers and is all that the driver sees. Each block is then
permuted, its rows go to the shards in the drawn numbers, and each shard is permuted again, in slices whose sizes give the slots their offsets. Shard sizes
are at most one apart. Everything depends on the seed and the rows alone, so a task that runs again deals alike.

Ties: rows with equal keys are ordered by a hash of all columns; rows equal in all columns are interchangeable, and
they share a block. Null keys are keys. Input columns named like an output are replaced. An empty table stays empty.
"""

from __future__ import annotations

import json
import random
from math import exp, lgamma

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranges import partitions


def hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many good ones are among `draws` taken without putting back: exact inversion, outwards from the mode."""
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def choose(n, k):
        return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    u = rng.random()
    up = down = exp(choose(good, mode) + choose(bad, draws - mode) - choose(good + bad, draws))
    u -= up
    a = b = mode
    while u > 0 and (a > low or b < high):
        if b < high:
            up *= (good - b) * (draws - b) / ((b + 1) * (bad - draws + b + 1))
            b += 1
            u -= up
            if u <= 0:
                return b
        if a > low:
            down *= a * (bad - draws + a) / ((good - a + 1) * (draws - a + 1))
            a -= 1
            u -= down
            if u <= 0:
                return a
    return mode


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows of each block that go to each shard; columns add up to sizes at most one apart."""
    rng, total = random.Random(seed), sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for n in counts:
        left, row = sum(room), []
        for s in range(shards):
            left -= room[s]
            k = hypergeometric(rng, room[s], left, n)
            row.append(k)
            room[s] -= k
            n -= k
        matrix.append(row)
    return matrix


def uniform_shards(df: DataFrame, shards: int, keys: list[str] | None = None, seed: int = 1) -> DataFrame:
    """Add shard (0 to shards - 1) and slot (gapless from 0 in each shard); `keys` (all columns) tell rows apart."""
    df = df.drop("shard", "slot")
    spark, keys = df.sparkSession, keys or df.columns
    blocks = max(1, partitions(spark))
    slices = blocks // shards + 1

    def drawn(k: int):
        return F.xxhash64(F.lit(seed * 4 + k), *keys, "__row")

    dealt = df.withColumn("__row", F.xxhash64(*df.columns)).withColumn("__block", F.pmod(drawn(0), F.lit(blocks)).cast("int"))
    counted = {r["__block"]: r["count"] for r in dealt.groupBy("__block").count().collect()}
    matrix = communication_matrix([counted.get(b, 0) for b in range(blocks)], shards, seed)
    edges = [[sum(row[: s + 1]) for s in range(shards)] for row in matrix]
    table = spark.range(1).select(F.posexplode(F.from_json(F.lit(json.dumps(edges)), "array<array<bigint>>"))).select(
        F.col("pos").alias("__block"), F.col("col").alias("__edges"))

    def exchanged(rows: DataFrame) -> DataFrame:
        inside = Window.partitionBy("__block").orderBy(drawn(1), *keys, "__row")
        rows = rows.withColumn("__rank", F.row_number().over(inside)).join(F.broadcast(table), "__block")
        shard = F.size(F.filter("__edges", lambda e: e < F.col("__rank")))
        return rows.withColumn("shard", shard.cast("int")).withColumn(
            "__slice", F.pmod(drawn(2), F.lit(slices)).cast("int")).drop("__block", "__rank", "__edges")

    sizes = exchanged(dealt.select("__block", "__row", *keys)).groupBy("shard", "__slice").agg(F.count("*").alias("__size"))
    before = Window.partitionBy("shard").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("shard", "__slice", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("shard", "__slice").orderBy(drawn(3), *keys, "__row")
    out = exchanged(dealt).withColumn("slot", F.row_number().over(inside).cast("long") - 1)
    out = out.join(F.broadcast(sizes), ["shard", "__slice"]).withColumn("slot", F.col("slot") + F.col("__start"))
    return out.select(*df.columns, "shard", "slot")
