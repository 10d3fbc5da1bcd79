"""Order over a whole table without one task that sees all of it: key ranges, and each row's successor."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_of(df: DataFrame, key: str, parts: int) -> Column:
    """The number (0 to parts - 1) of the range that the key is in; ranges hold about equally many distinct keys.

    The bounds are quantiles of all keys; at most `parts` numbers reach the driver. Nulls come first. Equal keys are
    always in one range.
    """
    bounds = df.select(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [0.5], 10000)).first()[0]
    bounds = sorted(set(bounds or []))
    if not bounds:
        return F.lit(0)
    step = isqrt(len(bounds)) + 1
    blocks = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    firsts, rest = F.array(*[F.lit(b[0]) for b in blocks]), F.array(*[F.array(*map(F.lit, b)) for b in blocks])
    passed = F.size(F.filter(firsts, lambda b: b <= F.col(key)))
    inside = F.size(F.filter(F.get(rest, passed - 1), lambda b: b <= F.col(key)))
    return F.when(F.coalesce(passed, F.lit(0)) == 0, 0).otherwise((passed - 1) * step + inside).cast("int")


def with_next(df: DataFrame, key: str, columns: list[str], prefix: str = "next_") -> DataFrame:
    """Add `columns` of the following row in ascending key order, under `prefix`; after the last row comes the first.

    Nulls sort first and equal keys by a hash of the other columns. One exchange by key range; the first row of each
    range (at most one per range, found by its key) also visits the range before it.
    """
    parts = max(2, partitions(df.sparkSession))
    others = [c for c in df.columns if c != key]
    tie = F.xxhash64(*others) if others else F.lit(0)
    order = F.struct(F.col(key).isNotNull(), key)
    narrow = df.select(key)
    rows = df.withColumn("__part", range_of(narrow, key, parts)).withColumn("__head", F.lit(False))
    heads = narrow.withColumn("__part", range_of(narrow, key, parts)).groupBy("__part").agg(F.min(order)[key].alias("__key"))
    everything = Window.partitionBy(F.lit(0)).orderBy("__part")  # at most one row per range
    before = F.coalesce(F.lag("__part").over(everything), F.max("__part").over(Window.partitionBy(F.lit(0))))
    heads = heads.withColumn("__to", before)
    found = df.join(F.broadcast(heads), F.col(key).eqNullSafe(F.col("__key")))
    first = Window.partitionBy("__part").orderBy(tie)
    found = found.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    found = found.select(*df.columns, F.col("__to").alias("__part"), F.lit(True).alias("__head"))
    w = Window.partitionBy("__part").orderBy("__head", key, tie)
    nexts = [F.lead(c).over(w).alias(f"{prefix}{c}") for c in columns]
    return rows.unionByName(found).select("*", *nexts).where("NOT __head").drop("__part", "__head")
