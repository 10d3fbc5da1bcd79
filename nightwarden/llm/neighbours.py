"""Approximate nearest neighbours by a hierarchical k-means tree, visited best bin first.

An upper tree, fitted by k-means on a sample of at most SAMPLE_ROWS vectors, has a leaf (cell) for about CELL_ROWS rows,
at most MAX_CELLS cells. Every row goes down it to its cell; cells are dealt into pieces of bounded size, and each piece
gets a tree of its own, fitted on all its rows, down to leaves of LEAF_ROWS rows. The pieces are the index, a table.

A query walks the upper tree with a priority queue (nearest centre first) and visits `cells` cells; in their pieces it
walks the piece's tree the same way and visits `leaves` leaves. How many are needed is calibrated: up to CALIBRATION
queries are compared with all rows, which tells for each of their true neighbours the cell and the leaf, in visiting
order, where it is found; visits are widened until the share of them that is reached is `recall` or more. Where the data
have no structure that may be everything, and the search is exact.

Equal vectors are one entry with the k + 1 smallest ids, as no query can need more, so copies cost nothing.

Vectors that are null, zero, empty, of another length than most, or hold null or non-finite components take no part, neither do
rows without an id. Rows equal in id and vector are candidates each; rows that share an id are one query, by the smallest
vector, and never its neighbours. With fewer than k candidates all visited ones are returned; an empty table or no query
gives no rows. Distances are those of the original vectors, so ties are exact and go to the smaller id. Other columns
are not read, whatever their names; there is no text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import pack, spread, unpack
from .ranges import partitions
from .vectors import finite, in_pieces, matrix, meet, of_common_width, sample

SAMPLE_ROWS = 16384
MAX_CELLS = 1024
CELL_ROWS = 16384
SMALL_CELL = 256
LEAF_ROWS = 64
BRANCH = 8
ROUNDS = 8
CALIBRATION = 256
QUERY_ROWS = 256


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, up to rounding."""
    return (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """The number of each row's cluster, from 0 without gaps."""
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        mine = squares(x, centers).argmin(1)
        used, mine = np.unique(mine, return_inverse=True)
        moved = (np.arange(len(used))[:, None] == mine).astype(np.float64) @ x / np.bincount(mine)[:, None]
        if moved.shape == centers.shape and np.allclose(moved, centers):
            break
        centers = moved
    return mine


@dataclass
class Tree:
    """Nodes with centres; the children of node i are first[i] to last[i] - 1, a leaf has none and a number."""

    centers: np.ndarray
    first: np.ndarray
    last: np.ndarray
    leaf: np.ndarray

    def arrays(self) -> list[np.ndarray]:
        return [self.centers.ravel(), self.first, self.last, self.leaf]

    @classmethod
    def of(cls, centers: np.ndarray, first: np.ndarray, last: np.ndarray, leaf: np.ndarray) -> Tree:
        return cls(centers.reshape(len(first), -1), first, last, leaf)

    def descend(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row reaches through the nearest centres."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            low, high = self.first[node], self.last[node]
            if low == high:
                out[rows] = self.leaf[node]
                continue
            near = squares(x[rows], self.centers[low:high]).argmin(1)
            todo += [(low + c, mine) for c in range(high - low) if len(mine := rows[near == c])]
        return out

    def best_bins(self, x: np.ndarray, most: int) -> list[list[int]]:
        """For each row the first `most` leaves, nodes taken from a queue by falling nearness of their centres."""
        first, last, leaf = self.first.tolist(), self.last.tolist(), self.leaf.tolist()
        out = []
        for away in squares(x, self.centers).tolist():
            queue, order = [(0.0, 0)], []
            while queue and len(order) < most:
                _, node = heappop(queue)
                if first[node] == last[node]:
                    order.append(leaf[node])
                for child in range(first[node], last[node]):
                    heappush(queue, (away[child], child))
            out.append(order)
        return out


def grow(x: np.ndarray, leaves: int, leaf_rows: int, seed: int) -> tuple[Tree, np.ndarray]:
    """A tree of at most `leaves` leaves, the largest split first, until they hold `leaf_rows` rows; and each row's leaf."""
    rng = np.random.default_rng(seed)
    centers, first, last, rows = [x.mean(0)], [0], [0], [np.arange(len(x))]
    queue, n = [(-len(x), 0)], 1
    while queue and n < leaves and -queue[0][0] > leaf_rows:
        node = heappop(queue)[1]
        mine = rows[node]
        k = min(BRANCH, leaves - n + 1, -(-len(mine) // leaf_rows))
        of = k_means(x[mine], k, rng)
        if not of.any():  # rows as good as equal
            of = np.arange(len(mine)) * k // len(mine)
        first[node], last[node] = len(centers), len(centers) + int(of.max()) + 1
        for c in range(int(of.max()) + 1):
            part = mine[of == c]
            heappush(queue, (-len(part), len(centers)))
            centers.append(x[part].mean(0))
            rows.append(part)
            first.append(0)
            last.append(0)
        n += int(of.max())
    first, last = np.array(first), np.array(last)
    leaf, of = np.full(len(first), -1), np.zeros(len(x), np.int64)
    ends = np.flatnonzero(first == last)
    leaf[ends] = np.arange(len(ends))
    for number, node in enumerate(ends):
        of[rows[node]] = number
    return Tree(np.array(centers), first, last, leaf), of


@dataclass
class Piece:
    """Vectors in the order of their leaves, each with its ids."""

    tree: Tree
    edges: np.ndarray
    vectors: np.ndarray
    id_edges: np.ndarray
    ids: np.ndarray

    @classmethod
    def open(cls, *arrays: np.ndarray) -> Piece:
        tree = Tree.of(*arrays[:4])
        return cls(tree, arrays[4], arrays[5].reshape(-1, tree.centers.shape[1]), *arrays[6:])

    def search(self, own: np.ndarray, x: np.ndarray, k: int, visits: int) -> tuple[np.ndarray, ...]:
        """(query, id, distance, turn) of the k nearest rows in each query's leaves, and the turn the leaf was visited."""
        turn = np.full((len(x), len(self.edges) - 1), -1, np.int32)
        for i, order in enumerate(self.tree.best_bins(x, visits)):
            turn[i, order] = np.arange(len(order))
        about = np.full((len(x), len(self.vectors)), np.inf)
        for leaf in range(turn.shape[1]):
            at = np.flatnonzero(turn[:, leaf] >= 0)
            low, high = self.edges[leaf], self.edges[leaf + 1]
            if len(at):
                about[at, low:high] = squares(x[at], self.vectors[low:high])
        most = min(k + 1, about.shape[1])  # k of them hold an id other than the query's
        bound = np.partition(about, most - 1, axis=1)[:, most - 1]
        slack = 1e-9 * ((x * x).sum(1) + (self.vectors ** 2).sum(1).max())
        q, v = np.nonzero(np.isfinite(about) & (about <= (bound + slack)[:, None]))
        away = np.sqrt(((x[q] - self.vectors[v]) ** 2).sum(1))
        each = self.id_edges[v + 1] - self.id_edges[v]
        ids = self.ids[spread(self.id_edges[v], each)]
        q, away, v = np.repeat(q, each), np.repeat(away, each), np.repeat(v, each)
        other = ids != own[q]
        q, away, v, ids = q[other], away[other], v[other], ids[other]
        by = np.lexsort((ids, away, q))
        rank = np.arange(len(by)) - np.searchsorted(q[by], q[by])
        by = by[rank < k]
        leaf = np.searchsorted(self.edges, v[by], "right") - 1
        return q[by], ids[by], away[by], turn[q[by], leaf]


@dataclass
class Index:
    """The upper tree, the pieces of its cells, and the pieces as rows (piece, blob) of a table."""

    tree: Tree
    cells: dict[int, range]
    pieces: DataFrame
    width: int


def entries(vectors: DataFrame, k: int, id: str, vector: str) -> tuple[DataFrame, int]:
    """(vector, ids) of every distinct vector, with its k + 1 smallest ids, each as often as it occurs (at most k times)."""
    rows = vectors.select(F.col(id).cast("long").alias("id"), finite(F.col(vector)).alias("vector"))
    rows, width = of_common_width(rows.where("id IS NOT NULL AND vector IS NOT NULL AND exists(vector, x -> x <> 0)"))
    rows = rows.groupBy("vector", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times"))
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= k + 1)
    rows = rows.groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("id", "times"))).alias("ids"))
    return rows.select("vector", F.flatten(F.transform("ids", lambda x: F.array_repeat(x["id"], x["times"]))).alias("ids")), width


def build(vectors: DataFrame, k: int, id: str = "vec_id", vector: str = "vector") -> Index | None:
    """Index every row for searches of up to k neighbours; None without a vector that takes part."""
    rows, width = entries(vectors, k, id, vector)
    rows = cut_lineage(rows)
    total = rows.count()
    if not total:
        return None
    small = min(-(-total // SMALL_CELL), 4 * partitions(rows.sparkSession))  # enough for all tasks
    cells = min(MAX_CELLS, max(-(-total // CELL_ROWS), small))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.concatenate([matrix(b.column(0), width) for b in batches])
        tree, _ = grow(x[np.lexsort(x.T)], cells, 1, 0)
        yield pa.RecordBatch.from_arrays([pa.array([pack(*tree.arrays())], pa.binary())], ["blob"])

    blob = sample(rows.select("vector"), SAMPLE_ROWS, total).repartition(1).mapInArrow(fit, "blob binary").first()[0]
    tree = Tree.of(*unpack(bytes(blob)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = tree.descend(matrix(b.column(0), width)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], ["vector", "ids", "cell"])

    rows = cut_lineage(rows.mapInArrow(assign, "vector array<double>, ids array<bigint>, cell int"))
    rows, pieces = in_pieces(rows, "cell", "vector", max(-(-total // cells), SMALL_CELL))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, x = b.column(1).slice(i, 1).flatten().flatten()
                x, each = matrix(x, width), np.diff(ids.offsets.to_numpy())
                mine, of = grow(x, len(x), LEAF_ROWS, b.column(0)[i].as_py())
                by = np.argsort(of, kind="stable")
                edges, starts = np.r_[0, np.cumsum(np.bincount(of))], np.r_[0, np.cumsum(each)]
                names = ids.flatten().to_numpy()[spread(starts[by], each[by])]
                blob = pack(*mine.arrays(), edges, x[by].ravel(), np.r_[0, np.cumsum(each[by])], names)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([blob], pa.binary())], ["piece", "blob"])

    rows = rows.groupBy("piece").agg(F.sort_array(F.collect_list(F.struct("ids", "vector"))).alias("rows"))
    return Index(tree, pieces, cut_lineage(rows.mapInArrow(index, "piece int, blob binary")), width)


def visit(index: Index, queries: DataFrame, k: int, cells: int, leaves: int) -> DataFrame:
    """(query_id, rank, id, score, cell, leaf) of the queries (id, vector); cell and leaf: the turn each was visited."""
    tree, pieces, width = index.tree, index.cells, index.width

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, x = b.column(0).to_numpy(), matrix(b.column(1), width)
            goes: dict[int, list[tuple[int, int]]] = {}
            for i, order in enumerate(tree.best_bins(x, cells) if len(x) else []):
                for turn, cell in enumerate(order):
                    for piece in pieces.get(cell, ()):
                        goes.setdefault(piece, []).append((i, turn))
            for piece, mine in goes.items():
                at, turn = np.array(mine).T
                yield pa.RecordBatch.from_arrays([
                    pa.array([piece], pa.int32()), pa.array([pack(own[at], turn, x[at].ravel())], pa.binary())], ["piece", "blob"])

    def answer(piece: Piece, own: np.ndarray, turn: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
        x, got = x.reshape(len(own), -1), []
        for low in range(0, len(own), QUERY_ROWS):
            mine = slice(low, low + QUERY_ROWS)
            q, ids, away, leaf = piece.search(own[mine], x[mine], k, leaves)
            got.append((own[mine][q], ids, away, turn[mine][q], leaf))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*got), kinds)], ["query_id", "id", "score", "cell", "leaf"])

    found = meet(index.pieces, queries.select("id", "vector").mapInArrow(route, "piece int, blob binary"), Piece.open, answer,
                 "query_id bigint, id bigint, score double, cell int, leaf int")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score", "cell", "leaf")


def widen(turns: list[tuple[int, int]], recall: float) -> tuple[int, int]:
    """(cells, leaves): the fewest visits that reach the share `recall` of the neighbours found at these turns."""
    need, best = max(1, int(np.ceil(recall * len(turns)))), None
    for cells in sorted({c + 1 for c, _ in turns}):
        reached = sorted(leaf for c, leaf in turns if c < cells)
        if len(reached) >= need:
            leaves = reached[need - 1] + 1
            if best is None or cells * leaves < best[0] * best[1]:
                best = cells, leaves
    return best or (1, 1)


def calibrate(index: Index, queries: DataFrame, k: int, recall: float) -> tuple[int, int]:
    """(cells, leaves) to visit, from the exact neighbours of at most CALIBRATION queries; at most k times as many rows are collected."""
    some = sample(queries, CALIBRATION, queries.count(), "id")
    exact = visit(index, some, k, len(index.tree.first), 1 << 30).select("cell", "leaf").collect()
    return widen([tuple(r) for r in exact], recall)


def nearest(vectors: DataFrame, k: int, is_query: Column, id: str = "vec_id", vector: str = "vector", recall: float = 0.95) -> DataFrame:
    """(query_id, rank, id, score) of the nearest rows found for each row that `is_query` names, by Euclidean distance."""
    index = build(vectors, k, id, vector)
    if index is None:
        return vectors.sparkSession.range(0).selectExpr("id query_id", "0 rank", f"id `{id}`", "0D score")
    queries = vectors.where(is_query).select(F.col(id).cast("long").alias("id"), finite(F.col(vector)).alias("vector"))
    queries = queries.where(f"id IS NOT NULL AND size(vector) = {index.width} AND exists(vector, x -> x <> 0)")
    queries = cut_lineage(queries.groupBy("id").agg(F.min("vector").alias("vector")))
    found = visit(index, queries, k, *calibrate(index, queries, k, recall))
    return found.select("query_id", "rank", F.col("id").alias(id), "score")
