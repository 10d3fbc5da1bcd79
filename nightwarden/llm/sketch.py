"""Threshold-scaled document sketches: every shingle hash below a fixed fraction of the hash range is kept.

Which hashes are kept does not depend on the document, so sketches of parts can be merged into the sketch of the whole,
and the share of a small document inside a far longer one can be estimated (a fixed number of minima can't do either).
All of it is Spark expressions.

A text's shingles are its distinct runs of `n` words (separated by space and the controls from tab to carriage return);
with 1 to n - 1 words, the whole sequence is one shingle; without words, or for null, there is none and the sketch is
empty. If no shingle falls below the fraction, the smallest one stands in, so a text with words never has an empty
sketch. Two empty sketches are alike (1.0); an empty one is unlike (0.0) any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 5
SCALE = 4


def _last(scale: int) -> int:
    """The largest hash that is kept."""
    return -(2**63) + 2**64 // scale - 1


def _retain(hashes: Column, scale: int) -> Column:
    kept = F.filter(hashes, lambda h: h <= F.lit(_last(scale)))
    return F.when(F.size(kept) > 0, F.array_sort(F.array_distinct(kept))).when(
        F.size(hashes) > 0, F.array(F.array_min(hashes))).otherwise(F.array().cast("array<bigint>"))


def with_sketch(df: DataFrame, text: str = "text", out: str = "sketch", n: int = WORDS, scale: int = SCALE) -> DataFrame:
    """Add the sketch of a text column as a sorted array of longs; a column named `out` is replaced."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    df = df.withColumn("__words", F.transform(words, lambda w: F.xxhash64(w)))
    at, size = F.col("__words"), F.size("__words")
    runs = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.xxhash64(*[F.get(at, i + j) for j in range(n)]))
    hashes = F.when(size >= n, runs).when(size > 0, F.array(F.xxhash64(size, at))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("__hashes", hashes).withColumn(out, _retain(F.col("__hashes"), scale)).drop("__words", "__hashes")


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """The sketch of two shingle sets together, from their sketches."""
    return _retain(F.array_union(a, b), scale)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1."""
    both = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - both
    return F.when(whole == 0, F.lit(1.0)).otherwise(both / whole)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; 1 for an empty a."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_text(sketch: Column) -> Column:
    """A sketch written as 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")
