"""Hard negatives of anchors, found in R-trees packed by Sort-Tile-Recursive.

Vectors hold whole numbers. Rows are tiled: a sample of at most SAMPLE_ROWS rows is sorted by its first coordinate and cut
into slabs, each slab by the next one, and so on (the label first, then the components of largest variance), and the cuts
deal every row to a tile (at most MAX_TILES). Tiles are dealt into pieces of bounded size, and each piece is packed the same
way into leaves of LEAF_ROWS rows and nodes of FANOUT children, each with its minimum bounding box: the least and largest
value of every component and of the label. A box gives an interval for its rows' inner products with an anchor, summed over the
components.

A search goes best first through a queue of boxes by the upper end of their intervals. A box is left out if no label in it is
wanted, if its interval lies outside all score windows, or if it ends strictly below the k-th score (equal ones may hold a
smaller id). The same bounds on whole tiles say which pieces an anchor visits: first one of its best tile's pieces, which gives it a k-th
score to start from, then all the others that may hold a better row.

Positives of an anchor are its first rows of the same label; for each of them, negatives are the first rows of other labels whose score
is in the window between `low` and `high` times its score. All windows of an anchor are searched in one walk.

Rows with a null label, id or vector, with null or non-finite components or with a vector of another length than most take no part.
Repeated rows are candidates each, also as positives; rows that share an id are one anchor, by the smallest vector and label, and never partners of each
other. Ties go to the smaller id. Anchors without positives, windows without rows and empty tables give no rows. Scores are exact while
100 * score stays below 2**53; larger ones raise OverflowError. Other columns are not read, whatever their names; there is no text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import pack, unpack
from .ranges import partitions
from .vectors import in_pieces, matrix, meet, of_common_width, sample

SAMPLE_ROWS = 16384
MAX_TILES = 1024
TILE_ROWS = 16384
SMALL_TILE = 256
LEAF_ROWS = 64
FANOUT = 16
SORTED = 4
QUERY_ROWS = 256


def slabs(tiles: int, left: int) -> int:
    """Into how many slabs the next of `left` coordinates is cut."""
    return ceil(tiles ** (1 / left)) if left > 1 else tiles


def tile_cuts(points: np.ndarray, tiles: int, at: int = 0) -> tuple:
    """Nested cuts (values, the parts between them) of sorted tiles; () for a tile that is not cut."""
    left = points.shape[1] - at
    if tiles < 2 or not left or not len(points):
        return ()
    n = slabs(tiles, left)
    values = np.unique(np.sort(points[:, at])[np.arange(1, n) * len(points) // n])
    of = np.searchsorted(values, points[:, at], "right")
    return values, [tile_cuts(p, round(tiles * len(p) / len(points)), at + 1) for p in (points[of == i] for i in range(len(values) + 1))]


def tile_of(points: np.ndarray, cuts: tuple) -> tuple[np.ndarray, int]:
    """The tile of each row, and the number of tiles."""
    if not cuts:
        return np.zeros(len(points), np.int64), 1
    values, parts = cuts
    slab, out, n = np.searchsorted(values, points[:, 0], "right"), np.zeros(len(points), np.int64), 0
    for i, part in enumerate(parts):
        rows = np.flatnonzero(slab == i)
        inner, size = tile_of(points[rows, 1:], part)
        out[rows] = n + inner
        n += size
    return out, n


def packed_order(points: np.ndarray, rows: int) -> np.ndarray:
    """Rows in Sort-Tile-Recursive order: consecutive runs of `rows` of them are near each other."""
    def order(mine: np.ndarray, at: int) -> np.ndarray:
        mine = mine[np.argsort(points[mine, at], kind="stable")]
        n = slabs(-(-len(mine) // rows), points.shape[1] - at)
        if at + 1 == points.shape[1] or n < 2:
            return mine
        step = -(-(-(-len(mine) // n)) // rows) * rows
        return np.concatenate([order(mine[i:i + step], at + 1) for i in range(0, len(mine), step)])

    return order(np.arange(len(points)), 0)


def spans(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) that the inner product of each row of x with a row in each box can be."""
    plus, minus = np.maximum(x, 0), np.minimum(x, 0)
    return plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T


@dataclass
class Boxes:
    """Minimum bounding boxes of components and labels."""

    low: np.ndarray
    high: np.ndarray
    least: np.ndarray
    most: np.ndarray

    def over(self, edges: np.ndarray) -> Boxes:
        """The boxes around runs that start at the edges."""
        return Boxes(np.minimum.reduceat(self.low, edges), np.maximum.reduceat(self.high, edges),
                     np.minimum.reduceat(self.least, edges), np.maximum.reduceat(self.most, edges))

    def wanted(self, labels: np.ndarray, same: bool) -> np.ndarray:
        """Which boxes can hold a row of each label (or, unless `same`, of another one)."""
        labels = labels[:, None]
        return (self.least <= labels) & (labels <= self.most) if same else (self.least != labels) | (labels != self.most)


@dataclass
class Piece:
    """Rows in packed order, and the boxes of every level, the leaves' first."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    levels: list[Boxes]

    @classmethod
    def open(cls, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> Piece:
        vectors = vectors.reshape(len(ids), -1).astype(np.float64)
        levels, boxes, size = [], Boxes(vectors, vectors, labels, labels), LEAF_ROWS
        while len(boxes.least) > 1 or not levels:
            boxes = boxes.over(np.arange(0, len(boxes.least), size))
            levels.append(boxes)
            size = FANOUT
        return cls(ids, labels, vectors, levels)

    def search(self, own: np.ndarray, labels: np.ndarray, x: np.ndarray, windows: np.ndarray, floor: np.ndarray, k: int,
               same: bool) -> tuple[np.ndarray, ...]:
        """(query, window, id, score) of the k best rows in each window, and the number of leaves scored.

        windows is queries x windows x 2 (least and largest score); floor is a known k-th score of each window.
        """
        n, m = windows.shape[:2]
        bounds = [spans(x, b.low, b.high) for b in self.levels]
        wanted = [b.wanted(labels, same) for b in self.levels]
        lists = [(lower.tolist(), upper.tolist(), keep.tolist()) for (lower, upper), keep in zip(bounds, wanted)]
        counts = [len(b.least) for b in self.levels]
        queues = [[] for _ in range(n)]
        score, best = np.full((n, m, k), -np.inf), np.full((n, m, k), np.iinfo(np.int64).max)
        asked = windows.tolist()

        def useful(q: int, level: int, node: int, kth: list[float]) -> bool:
            lower, upper, keep = lists[level]
            if not keep[q][node]:
                return False
            lo, hi = lower[q][node], upper[q][node]
            return any(lo <= w[1] and hi >= w[0] and hi >= t for w, t in zip(asked[q], kth))

        start = np.maximum(floor, score[:, :, k - 1]).tolist()
        top = len(self.levels) - 1
        for q in range(n):
            for node in range(counts[top]):
                if useful(q, top, node, start[q]):
                    heappush(queues[q], (-lists[top][1][q][node], top, node))
        active, scored = [q for q in range(n) if queues[q]], 0
        while active:
            kths = np.maximum(floor[active], score[active, :, k - 1]).tolist()
            goes: dict[int, list[int]] = {}
            for q, kth in zip(active, kths):
                queue = queues[q]
                while queue:
                    _, level, node = heappop(queue)
                    if not useful(q, level, node, kth):
                        continue
                    if not level:
                        goes.setdefault(node, []).append(q)
                        break
                    for child in range(node * FANOUT, min((node + 1) * FANOUT, counts[level - 1])):
                        if useful(q, level - 1, child, kth):
                            heappush(queue, (-lists[level - 1][1][q][child], level - 1, child))
            for leaf, mine in goes.items():
                at, rows = np.array(mine), slice(leaf * LEAF_ROWS, (leaf + 1) * LEAF_ROWS)
                ids = self.ids[rows]
                found = x[at] @ self.vectors[rows].T
                good = (ids != own[at, None]) & ((self.labels[rows] == labels[at, None]) == same)
                inside = good[:, None] & (found[:, None] >= windows[at, :, :1]) & (found[:, None] <= windows[at, :, 1:])
                found = np.where(inside, found[:, None], -np.inf)
                names = np.broadcast_to(ids, found.shape)
                found, names = np.concatenate([score[at], found], 2), np.concatenate([best[at], names], 2)
                by = np.lexsort((names, -found), axis=2)[:, :, :k]
                score[at], best[at] = np.take_along_axis(found, by, 2), np.take_along_axis(names, by, 2)
                scored += len(at)
            active = [q for q in active if queues[q]]
        q, w, r = np.nonzero(np.isfinite(score) & (score >= floor[:, :, None]))
        return q, w, best[q, w, r], score[q, w, r], scored


@dataclass
class Trees:
    """The tiles' boxes and pieces, and the pieces as rows (piece, blob) of a table."""

    boxes: Boxes
    pieces: list[range]
    table: DataFrame
    width: int


def build(rows: DataFrame, width: int) -> Trees | None:
    """Pack all rows (id, label, vector of whole numbers) into trees; None without rows."""
    total = rows.count()
    if not total:
        return None
    small = min(-(-total // SMALL_TILE), 4 * partitions(rows.sparkSession))  # enough for all tasks
    tiles = min(MAX_TILES, max(-(-total // TILE_ROWS), small))

    def points(labels: np.ndarray, x: np.ndarray, by: np.ndarray) -> np.ndarray:
        return np.column_stack([labels, x[:, by]])

    def columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2), width)

    def spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [columns(b) for b in batches]
        x, labels = np.concatenate([g[2] for g in got]), np.concatenate([g[1] for g in got])
        by = np.argsort(-x.var(0), kind="stable")[:SORTED]
        yield pa.RecordBatch.from_arrays([pa.array([pack(by, points(labels, x, by).ravel())], pa.binary())], ["blob"])

    some = sample(rows.select("id", "label", "vector"), SAMPLE_ROWS, total).repartition(1)
    by, flat = unpack(bytes(some.mapInArrow(spread_out, "blob binary").first()[0]))
    cuts = tile_cuts(flat.reshape(-1, len(by) + 1), tiles)  # the sample's few sorted coordinates, SAMPLE_ROWS at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, labels, x = columns(b)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tile_of(points(labels, x, by), cuts)[0], pa.int32())], ["id", "label", "vector", "tile"])

    rows = cut_lineage(rows.select("id", "label", "vector").mapInArrow(assign, "id bigint, label bigint, vector array<bigint>, tile int"))
    rows, pieces = in_pieces(rows, "tile", "id", max(-(-total // tiles), SMALL_TILE))

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Boxes] = {}
        for b in batches:
            _, labels, x = columns(b)
            tile = b.column(3).to_numpy()
            for t in np.unique(tile).tolist():
                at = tile == t
                parts = [Boxes(x[at], x[at], labels[at], labels[at])] + ([held[t]] if t in held else [])
                whole = Boxes(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("low", "high", "least", "most")))
                held[t] = whole.over(np.array([0]))
        for t, box in held.items():  # at most MAX_TILES
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(width + 1, t), pa.int32()), pa.array(np.arange(width + 1)),
                pa.array(np.r_[box.least, box.low[0]]), pa.array(np.r_[box.most, box.high[0]])], ["tile", "i", "low", "high"])

    ends = rows.select("id", "label", "vector", "tile").mapInArrow(surround, "tile int, i bigint, low double, high double")
    ends = ends.groupBy("tile", "i").agg(F.min("low"), F.max("high")).orderBy("tile", "i").collect()
    low, high = (np.array([r[c] for r in ends]).reshape(-1, width + 1) for c in (2, 3))
    boxes = Boxes(low[:, 1:], high[:, 1:], low[:, 0], high[:, 0])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, labels, x = b.column(1).slice(i, 1).flatten().flatten()
                ids, labels, x = ids.to_numpy(), labels.to_numpy(), matrix(x, width)
                order = packed_order(points(labels, x, by), LEAF_ROWS)
                blob = pack(ids[order], labels[order], x[order].astype(np.int64).ravel())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([blob], pa.binary())], ["piece", "blob"])

    rows = rows.groupBy("piece").agg(F.sort_array(F.collect_list(F.struct("id", "label", "vector"))).alias("rows"))
    return Trees(boxes, [pieces[t] for t in sorted(pieces)], cut_lineage(rows.mapInArrow(index, "piece int, blob binary")), width)


def best_rows(trees: Trees, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """(query, window, rank, id, score) of the k best rows in each window of the queries (id, label, vector, low, high).

    low and high are lists of least and largest scores, of the same length in all queries.
    """
    boxes, pieces, width = trees.boxes, trees.pieces, trees.width

    def visits(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                own, labels, x = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2), width)
                low, high, floor = (matrix(b.column(c), len(b.column(c).flatten()) // b.num_rows) for c in (3, 4, 5))
                least, most = spans(x, boxes.low, boxes.high)
                hit = (most[:, :, None] >= low[:, None]) & (least[:, :, None] <= high[:, None]) & boxes.wanted(labels, same)[:, :, None]
                top = np.where(hit.any(2), most, -np.inf).argmax(1)
                hit = hit.any(2) if first else (hit & (most[:, :, None] >= floor[:, None])).any(2)
                goes: dict[int, list[int]] = {}
                for q in range(b.num_rows):
                    begun = pieces[top[q]][0]
                    for t in [top[q]] if first else np.flatnonzero(hit[q]).tolist():
                        for piece in [begun] * bool(hit[q, t]) if first else pieces[t]:
                            if first or piece != begun:
                                goes.setdefault(piece, []).append(q)
                for piece, at in goes.items():
                    arrays = own[at], labels[at], x[at].astype(np.int64).ravel(), np.stack([low, high], 2)[at].ravel(), floor[at].ravel()
                    yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([pack(*arrays)], pa.binary())], ["piece", "blob"])
        return run

    def answer(piece: Piece, own: np.ndarray, labels: np.ndarray, x: np.ndarray, windows: np.ndarray, floor: np.ndarray) -> pa.RecordBatch:
        n, got = len(own), []
        x, windows, floor = x.reshape(n, -1).astype(np.float64), windows.reshape(n, -1, 2), floor.reshape(n, -1)
        for low in range(0, n, QUERY_ROWS):
            at = slice(low, low + QUERY_ROWS)
            q, w, ids, score, _ = piece.search(own[at], labels[at], x[at], windows[at], floor[at], k, same)
            got.append((own[at][q], w.astype(np.int32), ids, score.astype(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got)], ["query", "window", "id", "score"])

    def search(asked: DataFrame, first: bool) -> DataFrame:
        passing = asked.select("id", "label", "vector", "low", "high", "floor").mapInArrow(visits(first), "piece int, blob binary")
        return meet(trees.table, passing, Piece.open, answer, "query bigint, window int, id bigint, score bigint")

    def ranked(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query", "window").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    before = cut_lineage(ranked(search(queries.withColumn("floor", F.transform("low", lambda _: F.lit(float("-inf")))), True)))
    kth = before.where(F.col("rank") == k).groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("kth"))
    floor = F.transform("low", lambda _, i: F.coalesce(F.col("kth")[i].cast("double"), F.lit(float("-inf"))))
    asked = queries.join(kth, queries["id"] == kth["query"], "left").withColumn("floor", floor)
    return ranked(before.drop("rank").unionByName(search(asked, False)))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, den: int = 100,
         id: str = "vec_id", vector: str = "vector", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that `is_anchor` names.

    A negative's score s and the positive's p satisfy low * p <= den * s <= high * p.
    """
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"),
                          F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows, width = of_common_width(rows.where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL"))
    rows = cut_lineage(rows)
    largest = rows.agg(F.max(F.array_max(F.transform("vector", lambda v: F.abs(v))))).first()[0]
    if (largest or 0) ** 2 * width * den >= 2**53:
        raise OverflowError("inner products beyond 2**53")
    trees = build(rows, width)
    if trees is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    anchors = rows.where("anchor").groupBy("id").agg(F.min(F.struct("vector", "label")).alias("row"))
    anchors = cut_lineage(anchors.select("id", F.col("row.label").alias("label"), F.col("row.vector").alias("vector")))
    anywhere = {c: F.array(F.lit(float(x))) for c, x in (("low", "-inf"), ("high", "inf"))}
    near = cut_lineage(best_rows(trees, anchors.withColumns(anywhere), positives, True))
    near = near.select(F.col("query").alias("anchor_id"), (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))

    def bound(score: Column, factor: int, up: bool) -> Column:
        """The whole number next to factor * score / den from the inside, or a bound that no score meets without a score."""
        part = F.ceil(score * factor / den) if up else F.floor(score * factor / den)
        return F.coalesce(part.cast("double"), F.lit(float("inf" if up else "-inf")))

    scores = near.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("window", "positive_score"))).alias("scores"))
    every = F.array(*(F.col("scores")[F.lit(i)] for i in range(positives)))
    asked = anchors.join(scores, anchors["id"] == scores["anchor_id"]).withColumn("each", every)
    asked = asked.withColumns({"low": F.transform("each", lambda p: bound(p, low, True)), "high": F.transform("each", lambda p: bound(p, high, False))})
    found = best_rows(trees, asked.select("id", "label", "vector", "low", "high"), negatives, False)
    found = found.select(F.col("query").alias("anchor_id"), "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(near, ["anchor_id", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
