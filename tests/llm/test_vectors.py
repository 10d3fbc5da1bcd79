"""Nearest neighbours, whitening and hard negatives."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightwarden.llm import negatives, neighbours, queries, topk, whitening

BAD = [(1000, None), (1100, [1.0, None, 2.0, 0.0]), (1200, [float("nan"), 0.0, 0.0, 1.0]), (1300, [float("-inf"), 0.0, 0.0, 1.0]), (1400, [1.0]),
       (1500, []), (None, [0.25, 0.5, 0.25, 0.0])]


def table(spark, rows, schema="vec_id long, embedding array<double>, score string, rank int, piece string, label int"):
    """(id, vector, label) rows with columns whose names clash with those that operators use."""
    return spark.createDataFrame([(i, v, "x", 1, "y", label) for i, v, label in rows], schema).repartition(3)


def cloud(seed, n, width=4, grid=8):
    """Clustered vectors with ties and copies, a third of them one hot vector or close to it."""
    rng = random.Random(seed)
    centers = [[rng.randrange(-3 * grid, 3 * grid) for _ in range(width)] for _ in range(12)]
    rows = []
    for i in range(n):
        center = centers[0] if i % 3 == 0 else rng.choice(centers)
        jitter = 0 if i % 6 == 0 else 2
        rows.append((i - 40, [(c + rng.randint(-jitter, jitter)) / grid for c in center], rng.randrange(4)))
    return rows


# ---- neighbours ------------------------------------------------------------------------------------------------

def loop_nearest(rows, k, is_query):
    good = [(i, v) for i, v in rows if i is not None and any(v)]
    out = []
    for q, x in sorted({i: v for i, v in sorted(good, reverse=True) if is_query(i)}.items()):
        away = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, v))), i) for i, v in good if i != q)
        out += [(q, r, i, d) for r, (d, i) in enumerate(away[:k], 1)]
    return out


@pytest.fixture
def small_cells(monkeypatch):
    for module, names in ((neighbours, ("CELL_ROWS", "SMALL_CELL", "LEAF_ROWS", "QUERY_ROWS")), (negatives, ("TILE_ROWS", "SMALL_TILE", "LEAF_ROWS", "QUERY_ROWS"))):
        for name, value in zip(names, (32, 32, 4, 3)):
            monkeypatch.setattr(module, name, value)


def test_neighbours_are_exact_where_everything_is_reached(spark, small_cells):
    rows = cloud(1, 300) + [(0, [0.0] * 4, 1)]
    rows += [*rows[:2], rows[50], (rows[60][0], [9.0, 9.0, 9.0, 9.0], 1)]  # repeated rows, and an id with two vectors
    df = table(spark, rows + [(i, v, 1) for i, v in BAD])
    got = neighbours.nearest(df, 5, F.col("vec_id") % 10 == 0, vector="embedding", recall=1.0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == loop_nearest([(i, v) for i, v, _ in rows], 5, lambda i: i % 10 == 0)


def test_recall_is_reached_with_a_part_of_the_visits(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SMALL_CELL", 64)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 8)) * 3
    rows = [(i, (centers[rng.integers(40)] + rng.normal(size=8)).tolist(), 1) for i in range(4000)]
    df = table(spark, rows)
    seen, widen = [], neighbours.widen
    monkeypatch.setattr(neighbours, "widen", lambda *a: seen.append(widen(*a)) or seen[0])
    got = neighbours.nearest(df, 10, F.col("vec_id") % 20 == 0, vector="embedding").collect()
    want = loop_nearest([(i, v) for i, v, _ in rows], 10, lambda i: i % 20 == 0)
    hits = {r[:1] + r[2:3] for r in map(tuple, got)} & {r[:1] + r[2:3] for r in want}
    assert len(got) == len(want) and len(hits) >= 0.9 * len(want)
    assert seen[0][0] * seen[0][1] < 16


def test_every_row_is_indexed(spark, small_cells):
    rows = cloud(2, 400)
    index = neighbours.build(table(spark, rows), 500, vector="embedding")
    held = [neighbours.Piece.open(*neighbours.unpack(bytes(r.blob))) for r in index.pieces.collect()]
    assert sorted(x for p in held for x in p.ids.tolist()) == sorted(r[0] for r in rows)
    assert max(len(p.vectors) for p in held) < 100 and len(held) > 3  # hot cells are dealt into several pieces


def test_few_and_no_neighbours(spark):
    df = table(spark, [(0, [3.0, 0.0], 1), (1, [0.0, 4.0], 1), (2, [3.0, 0.0], 1)])
    got = neighbours.nearest(df, 10, F.col("vec_id") == 0, vector="embedding")
    assert sorted(map(tuple, got.collect())) == [(0, 1, 2, 0.0), (0, 2, 1, 5.0)]
    assert neighbours.nearest(df, 10, F.lit(False), vector="embedding").count() == 0
    assert neighbours.nearest(df.limit(1), 10, F.lit(True), vector="embedding").count() == 0
    none = neighbours.nearest(df.limit(0), 10, F.lit(True), vector="embedding")
    assert none.count() == 0 and none.dtypes == got.dtypes


def test_visits_are_the_fewest_that_reach():
    turns = [(0, 0)] * 6 + [(0, 5)] * 2 + [(3, 0)] * 2
    assert neighbours.widen(turns, 0.6) == (1, 1) and neighbours.widen(turns, 0.8) == (4, 1)
    assert neighbours.widen(turns, 1.0) == (4, 6) and neighbours.widen([], 0.9) == (1, 1)


def test_trees_of_equal_rows_end():
    tree, leaf = neighbours.grow(np.ones((1000, 3)), 1000, 10, 0)
    assert np.bincount(leaf).max() <= 10 and (tree.descend(np.ones((2, 3))) >= 0).all()


# ---- whitening -------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("values", [
    np.linspace(1, 2, 30), 1 + 1e-9 * np.arange(30), np.r_[1 + 1e-13 * np.arange(10), np.linspace(2, 3, 20)], np.ones(30),
    np.r_[np.zeros(10), np.linspace(1, 100, 20)], 10.0 ** np.arange(-10, 5, 0.5), np.r_[1 + 1e-6 * np.arange(15), 5 + 1e-8 * np.arange(15)]])
def test_eigenvectors_are_refined_to_double_precision(values):
    q, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(30, 30)))
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    got, x = whitening.eigen(a)
    size = np.abs(a).max()
    assert np.abs(a @ x - x * got).max() < 4e-15 * size and np.abs(x.T @ x - np.eye(30)).max() < 4e-15
    assert np.abs(got - np.linalg.eigvalsh(a)[::-1]).max() < 4e-15 * np.abs(values).max() * 4
    rough = np.linalg.eigh(a.astype(np.float32))[1].astype(float)
    assert np.abs(rough.T @ rough - np.eye(30)).max() > 1e-8  # what the solver gave


def test_one_step_squares_the_error():
    q, _ = np.linalg.qr(np.random.default_rng(2).normal(size=(8, 8)))
    a = ((q * np.arange(1, 9)) @ q.T).astype(whitening.HIGH)
    x = q.astype(whitening.HIGH) + 1e-4 * np.random.default_rng(3).normal(size=(8, 8))
    errors = []
    for _ in range(3):
        _, x, _ = whitening.refine(a, x)
        errors.append(float(np.abs(x.T @ x - np.eye(8)).max()))
    assert errors[0] < 1e-6 and errors[1] < 1e-12 and errors[2] < 1e-15


def plain_whitening(rows, k, scale, shift):
    x = np.array([[math.floor(scale * c) + shift for c in v] for _, v in rows])
    n, total = len(x), x.sum(0)
    away = x - total / n
    v = away.T @ away / n
    e, u = (a[..., ::-1] for a in np.linalg.eigh(v))
    return ((n * x - total) ** 2).sum(1), away @ u[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(v)


def test_whitening_equals_the_definition(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=4) * [3, 2, 1, 0.5]).tolist()) for i in range(300)] + [(None, [1.0, 2.0, 3.0, 4.0])]
    rows += rows[:3]
    df = table(spark, [(i, v, 1) for i, v in rows + BAD[:-1]])
    got = whitening.whiten(df, 3, vector="embedding")
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = got.collect()
    assert len(found) == 3 * len(rows) and {r.n for r in found} == {len(rows)}
    deviation, whitened, explained = plain_whitening(rows, 3, 64, 1_000_000)
    for j in (1, 2, 3):
        mine = sorted((r.deviation, r.whitened, r.explained) for r in found if r.component == j)
        want = np.array(sorted((r.whitened for r in found if r.component == j)))
        assert sorted(m[0] for m in mine) == sorted(deviation.tolist())
        assert min(np.abs(want - np.sort(s * whitened[:, j - 1])).max() for s in (1, -1)) < 1e-9
        assert abs(mine[0][2] - explained[j - 1]) < 1e-12
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-12


def test_whitening_without_variance_and_large_numbers(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema), vector="embedding").count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema), vector="embedding").count() == 0
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 2.0])], schema), vector="embedding").collect()
    assert [(r.component, abs(round(r.whitened, 9)), r.deviation) for r in flat] == [(1, 1.0, 64 * 64)] * 2
    wide = [(i, [float(i) * 2**30, 1.0]) for i in range(-3, 4)]
    got = whitening.whiten(spark.createDataFrame(wide, schema), vector="embedding").collect()
    want = {i: (7 * i * 2**36) ** 2 for i, _ in wide}
    assert all(r.deviation == (want[r.vec_id] if want[r.vec_id] < 2**63 else None) for r in got) and len(got) == 7
    with pytest.raises(Exception, match="beyond 2"):
        whitening.whiten(spark.createDataFrame([(1, [1e300]), (2, [0.0])], schema), vector="embedding").count()


# ---- hard negatives --------------------------------------------------------------------------------------------

def loop_negatives(rows, is_anchor, n_positive, n_negative):
    rows = [r for r in rows if r[0] is not None and r[2] is not None]
    out = []
    for a, (x, label) in sorted({i: (v, g) for i, v, g in sorted(rows, reverse=True) if is_anchor(i)}.items()):
        scored = [(-sum(p * q for p, q in zip(x, v)), i, g) for i, v, g in rows if i != a]
        for s, p, _ in sorted(r for r in scored if r[2] == label)[:n_positive]:
            inside = sorted(r for r in scored if r[2] != label and 30 * -s <= 100 * -r[0] <= 90 * -s)
            out += [(a, p, rank, i, -s, -t) for rank, (t, i, _) in enumerate(inside[:n_negative], 1)]
    return out


def test_negatives_equal_all_pairs(spark, small_cells):
    rows = [(i, [math.floor(8 * x) for x in v], None if i == 33 else g if i % 2 else 3) for i, v, g in cloud(5, 300)]
    rows += [*rows[:2], rows[50], (rows[60][0], [9, 9, 9, 9], 1)]  # repeated rows, and an id with two vectors; half of all rows share a label
    df = table(spark, [(i, [x / 8 for x in v], g) for i, v, g in rows] + [(i, v, 1) for i, v in BAD])
    df = df.withColumn("vector", topk.whole_numbers(F.col("embedding"), 8.0))
    got = negatives.mine(df, F.col("vec_id") % 10 == 0, 3, 4)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = loop_negatives(rows, lambda i: i % 10 == 0, 3, 4)
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == sorted(want)


def test_negatives_of_few_rows(spark):
    schema = "vec_id long, vector array<bigint>, label int"
    rows = [(0, [10], 1), (1, [9], 1), (2, [5], 2), (3, [-4], 2), (4, [0], 3), (5, [8], 2), (6, [8], 3)]
    got = negatives.mine(spark.createDataFrame(rows, schema), F.col("vec_id") == 0)
    assert sorted(map(tuple, got.collect())) == [(0, 1, 1, 5, 90, 80), (0, 1, 2, 6, 90, 80), (0, 1, 3, 2, 90, 50)]
    assert negatives.mine(spark.createDataFrame(rows[:1], schema), F.lit(True)).count() == 0
    assert negatives.mine(spark.createDataFrame([], schema), F.lit(True)).count() == 0
    with pytest.raises(OverflowError):
        negatives.mine(spark.createDataFrame([(0, [2**30], 1)], schema), F.lit(True))


def test_boxes_out_of_reach_are_not_scored():
    rng = np.random.default_rng(6)
    centers = rng.integers(-500, 500, (32, 3))
    x = (np.repeat(centers, 128, 0) + rng.integers(-3, 4, (32 * 128, 3))).astype(float)
    labels = np.arange(len(x)) % 5
    order = negatives.packed_order(np.column_stack([x[:, :2], labels]), negatives.LEAF_ROWS)
    piece = negatives.Piece.open(np.arange(len(x)), labels[order], x[order])
    anywhere = np.tile([-np.inf, np.inf], (20, 1, 1)).reshape(20, 1, 2)
    floor = np.full((20, 1), -np.inf)
    q, _, ids, score, scored = piece.search(np.full(20, -1), np.zeros(20, int), x[:20], anywhere, floor, 3, True)
    full = np.where(piece.labels == 0, x[:20] @ piece.vectors.T, -np.inf)
    assert (score.reshape(20, 3) == -np.sort(-full, 1)[:, :3]).all() and scored < 20 * len(x) / negatives.LEAF_ROWS / 4
    window = np.tile([1000.0, 2000.0], (20, 1, 1)).reshape(20, 1, 2)
    *_, scored = piece.search(np.full(20, -1), np.zeros(20, int), x[:20], window, floor, 3, False)
    assert scored < 20 * len(x) / negatives.LEAF_ROWS / 2


def test_queries_follow_their_contracts(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(int(i), rng.normal(size=6).astype(np.float32).tolist(), int(i % 10)) for i in range(700)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = queries.QUERIES["op11_neighbours"](spark, str(tmp_path))
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    want = loop_nearest([(i, v) for i, v, _ in rows], 10, lambda i: i % 100 == 0)
    got = found.collect()
    away = {(r[0], r[2]): r[3] for r in loop_nearest([(i, v) for i, v, _ in rows], 700, lambda i: i % 100 == 0)}
    assert all(abs(r.score - away[r.query_id, r.vec_id]) < 1e-12 for r in got)
    assert len({r[:3:2] for r in map(tuple, got)} & {r[:3:2] for r in want}) >= 0.9 * len(want) == 0.9 * len(got)
    wide = queries.QUERIES["op12_whitening"](spark, str(tmp_path)).collect()
    assert len(wide) == 700 * 6 and max(r.identity_error for r in wide) < 1e-10
    deviation, *_ = plain_whitening([(i, v) for i, v, _ in rows], 6, 64, 1_000_000)
    assert {r.vec_id: r.deviation for r in wide} == dict(enumerate(deviation.tolist()))
    hard = queries.QUERIES["op13_negatives"](spark, str(tmp_path)).collect()
    whole = [(i, [math.floor(256 * x) for x in v], (g + 1) % 10 if i % 7 == 0 else g) for i, v, g in rows]
    assert sorted(map(tuple, hard)) == sorted(loop_negatives(whole, lambda i: i % 100 == 0, 5, 10))
