"""Exact top-k search and uniform shards."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from nightwarden.llm import sharding, topk


def loop(vectors, k, is_query):
    out = []
    for q, v in sorted({i: v for i, v in reversed(vectors) if i is not None and is_query(i)}.items()):
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in vectors if i is not None and i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return out


def test_top_k_equals_all_pairs(spark, monkeypatch):
    for name, value in (("BLOCK_DOCS", 4), ("SUPERBLOCK_DOCS", 16), ("QUERY_CHUNK", 3)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(-3, 4)) / 256 for _ in range(3)]) for i in range(-40, 60)]  # many ties
    bad = [(1001, None), (1002, [1.0, None, 2.0]), (1010, [float("nan"), 0.0, 0.0]), (1003, [float("inf"), 0.0, 0.0]), (1020, [1.0]), (None, [0.1, 0.1, 0.1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad + rows[:2]], "vec_id long, embedding array<double>, score string, rank int")
    df = df.withColumn("vector", topk.whole_numbers(F.col("embedding")))
    got = topk.top_k(df, 5, F.col("vec_id") % 10 == 0)
    vectors = [(i, [math.floor(256 * x) for x in v]) for i, v in rows + rows[:2]]
    assert sorted(map(tuple, got.collect())) == sorted(loop(vectors, 5, lambda i: i % 10 == 0))
    assert got.columns == ["query_id", "rank", "vec_id", "score"]


def test_few_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [2.0]), (1, [-1.0]), (2, [1.0])], "vec_id long, vector array<double>")
    df = df.withColumn("vector", topk.whole_numbers(F.col("vector"), 1.0))
    assert sorted(map(tuple, topk.top_k(df, 5, F.col("vec_id") == 0).collect())) == [(0, 1, 2, 2), (0, 2, 1, -2)]
    assert topk.top_k(df, 5, F.lit(False)).count() == topk.top_k(df.limit(0), 5, F.lit(True)).count() == 0
    assert topk.top_k(df.limit(1), 5, F.lit(True)).count() == 0


def test_blocks_whose_bound_is_low_are_not_scored():
    rng = np.random.default_rng(1)
    vectors = np.repeat(rng.normal(size=(40, 8)) * 100, topk.BLOCK_DOCS, 0).round() + rng.integers(0, 2, (40 * topk.BLOCK_DOCS, 8))
    ids = np.arange(len(vectors))
    queries = vectors[::topk.BLOCK_DOCS]
    score, best, scored = topk.search(queries, ids[::topk.BLOCK_DOCS], vectors, ids, 5)
    assert scored < 40 * 40 / 4
    full = queries @ vectors.T
    full[np.arange(40), ids[::topk.BLOCK_DOCS]] = -np.inf
    assert (score == -np.sort(-full, 1)[:, :5]).all()


def test_shards_are_exact_and_repeatable(spark, docs, rows):
    got = sharding.uniform_shards(docs, 16, seed=3)
    assert got.columns.count("slot") == 1 and dict(got.dtypes)["slot"] == "bigint"
    again = sharding.uniform_shards(docs.repartition(2), 16, seed=3)
    a, b = (Counter(map(tuple, x.collect())) for x in (got, again))
    assert a == b and Counter((r[0], r[1]) for r in a.elements()) == Counter(rows)
    slots = {}
    for r in got.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(16)]
    assert max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    assert sharding.uniform_shards(docs.limit(0), 4).count() == 0


def test_shards_with_keys_that_repeat(spark, docs, rows):
    got = sharding.uniform_shards(docs.select("doc_id", "text"), 3, ["doc_id"]).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(3) for i in range(len(rows) // 3 + (s < len(rows) % 3))]


def test_every_place_is_as_likely(spark):
    df = spark.range(400).withColumnRenamed("id", "doc_id")
    seen = Counter()
    for seed in range(12):
        seen.update((r.doc_id // 100, r.shard) for r in sharding.uniform_shards(df, 4, seed=seed).collect())
    assert sum((seen[a, s] - 300) ** 2 / 300 for a in range(4) for s in range(4)) < 30  # 9 degrees of freedom


def test_draws_follow_the_hypergeometric_law():
    rng = random.Random(4)
    n = 20_000
    for good, bad, draws in ((5, 7, 6), (1, 30, 10), (40, 3, 20), (0, 5, 3), (5, 0, 3)):
        seen = Counter(sharding.hypergeometric(rng, good, bad, draws) for _ in range(n))
        for k in range(draws + 1):
            p = math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws)
            assert abs(seen[k] - n * p) <= 5 * math.sqrt(n * p * (1 - p)) + 1e-9
    assert abs(sharding.hypergeometric(rng, 10**10, 10**11, 10**6) - 10**6 / 11) < 3000


def test_the_matrix_adds_up():
    counts = [0, 5, 100, 33, 1]
    matrix = sharding.communication_matrix(counts, 4, 1)
    assert [sum(r) for r in matrix] == counts and [sum(c) for c in zip(*matrix)] == [35, 35, 35, 34]
    assert sharding.communication_matrix([], 3, 1) == []


def test_rows_of_one_key_are_spread_over_blocks(spark, monkeypatch):
    seen, matrix = [], sharding.communication_matrix
    monkeypatch.setattr(sharding, "communication_matrix", lambda counts, *a: seen.append(counts) or matrix(counts, *a))
    df = spark.createDataFrame([(None if i % 2 else 5, f"text {i}") for i in range(600)], "doc_id long, text string")
    got = sharding.uniform_shards(df, 4, ["doc_id"]).collect()
    assert max(seen[0]) < 300 and min(seen[0]) > 120
    assert sorted((r.shard, r.slot) for r in got) == [(s, i) for s in range(4) for i in range(150)] and len({r.text for r in got}) == 600
