"""Exact top-k inner products by block-at-a-time pruning.

Vectors are sparse documents over terms (here: components) with integer weights. A block is a range of consecutive
documents with a forward index (their weights) and, for each term, its largest and smallest weight. For a query, a
block's bound is the sum over the terms of the larger product. Each query takes the blocks of a superblock by falling
bound and scores documents through the forward index until the next bound is below its k-th score; equal bounds are
still scored, as ties go to the smaller id. The k best of every superblock are merged.

Queries are packed in chunks and meet every superblock once; what is in memory is one superblock and one chunk.

Vectors that are null or hold null or non-finite components take no part, neither do rows without an id, nor vectors of
another length than most. A query's candidates are all rows with another id; repeated rows are candidates each (rows that
share an id are one query, by the smallest vector). With fewer than k candidates all are returned. Sums are exact while they stay below 2**53; larger ones raise OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import partitions, range_of

BLOCK_DOCS = 256
SUPERBLOCK_DOCS = 32768
QUERY_CHUNK = 512


def whole_numbers(vector: Column, factor: float = 256.0) -> Column:
    """floor(factor * x) of each component, or null where a component is null or not finite."""
    x = F.transform(vector, lambda v: v.cast("double"))
    good = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & good, F.transform(x, lambda v: F.floor(v * F.lit(factor)).cast("bigint")))


def bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Queries x blocks: no document of a block scores more than this."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def better(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row, by falling score, then rising id."""
    by = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, by, 1), np.take_along_axis(ids, by, 1)


def search(queries: np.ndarray, own: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(scores, ids) of the k best of each query, -inf where there are fewer, and how many blocks were scored."""
    edges = np.arange(0, len(ids), BLOCK_DOCS)
    limit = bounds(queries, np.maximum.reduceat(vectors, edges), np.minimum.reduceat(vectors, edges))
    order = np.argsort(-limit, axis=1, kind="stable")
    score, best = np.full((len(queries), k), -np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
    active, scored = np.arange(len(queries)), 0
    for turn in range(len(edges)):
        block = order[active, turn]
        go = limit[active, block] >= score[active, k - 1]
        active, block = active[go], block[go]  # later blocks of a query have no higher bound
        if not len(active):
            break
        by = np.argsort(block, kind="stable")
        for at in np.split(by, np.flatnonzero(np.diff(block[by])) + 1):
            rows, low = active[at], edges[block[at[0]]]
            mine = vectors[low: low + BLOCK_DOCS]
            names = np.broadcast_to(ids[low: low + BLOCK_DOCS], (len(rows), len(mine)))
            found = queries[rows] @ mine.T
            found = np.where(names == own[rows, None], -np.inf, found)
            score[rows], best[rows] = better(np.hstack([score[rows], found]), np.hstack([best[rows], names]), k)
            scored += len(rows)
    return score, best, scored


def top_k(vectors: DataFrame, k: int, is_query: Column, id: str = "vec_id", vector: str = "vector") -> DataFrame:
    """(query_id, rank, id, score) of each row that `is_query` names against all rows; `vector` holds whole numbers."""
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"), is_query.alias("query"))
    rows = rows.where("id IS NOT NULL AND vector IS NOT NULL")
    width = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if width is None or not width["n"]:
        return vectors.sparkSession.range(0).selectExpr("id query_id", "0 rank", f"id `{id}`", "id score")
    rows = rows.where(F.size("vector") == width["n"])
    parts = max(1, min(partitions(vectors.sparkSession), rows.count() // SUPERBLOCK_DOCS + 1))

    def numbered(part: DataFrame, size: int, label: str) -> DataFrame:
        """One row for each `size` consecutive ids of a key range: its ids, and its vectors one after the other."""
        rank = F.row_number().over(Window.partitionBy("part").orderBy("id"))
        part = part.withColumn("part", range_of(part, "id", parts)).withColumn("pack", F.floor((rank - 1) / size).cast("int"))
        packs = part.groupBy("part", "pack").agg(F.sort_array(F.collect_list(F.struct("id", "vector"))).alias("rows"))
        return packs.select(F.struct("part", "pack").alias(label), F.col("rows.id").alias(f"{label}_ids"), F.flatten("rows.vector").alias(f"{label}_values"))

    blocks = numbered(rows.select("id", "vector"), SUPERBLOCK_DOCS, "block")
    chunks = numbered(rows.where("query").groupBy("id").agg(F.min("vector").alias("vector")), QUERY_CHUNK, "chunk")
    names = blocks.groupBy().agg(F.collect_set("block").alias("blocks"))  # one row; an entry for SUPERBLOCK_DOCS vectors
    pairs = chunks.join(F.broadcast(names)).withColumn("block", F.explode("blocks")).drop("blocks").join(blocks, "block")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(whole.num_rows):
                b = whole.slice(i, 1)
                own, q, ids, v = (b.column(c).flatten().to_numpy() for c in range(4))
                width = len(v) // len(ids)
                q, v = q.astype(np.float64).reshape(-1, width), v.astype(np.float64).reshape(-1, width)
                if max(np.abs(q).max(), np.abs(v).max()) ** 2 * width >= 2**53:
                    raise OverflowError("inner products beyond 2**53")
                found, names, _ = search(q, own, v, ids, k)
                good = np.isfinite(found)
                at = np.nonzero(good)[0]
                yield pa.RecordBatch.from_arrays([
                    pa.array(own[at], pa.int64()), pa.array(names[good], pa.int64()), pa.array(found[good].astype(np.int64), pa.int64()),
                ], ["query_id", id, "score"])

    found = pairs.select("chunk_ids", "chunk_values", "block_ids", "block_values").mapInArrow(score, f"query_id bigint, `{id}` bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), id)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", id, "score")
