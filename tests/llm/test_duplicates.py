"""Near-duplicate classes, repeated passages and sketches against their definitions."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nightwarden.llm import jaccard, repeats, sketch
from nightwarden.llm.components import components
from nightwarden.llm.ranges import range_of, with_next

from . import plain


def near_groups(seed, groups=12, size=9, words=60):
    rng, out = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(2, words))]
        for _ in range(rng.randrange(1, size)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(9)}"
            out.append(" ".join(copy + base[: rng.randrange(0, 3)]))
    return out


@pytest.mark.parametrize("n,num,small", [(3, 90, False), (5, 80, False), (2, 60, True)])
def test_classes_equal_the_definition(spark, docs, rows, n, num, small, monkeypatch):
    if small:  # frequent shingles, large clusters and a text shuffle in small
        monkeypatch.setattr(jaccard, "LIST", 3)
        monkeypatch.setattr(jaccard, "CLUSTER_BYTES", 3000)
        monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    more = [(1000 + i, t) for i, t in enumerate(near_groups(n))]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes_of(df, n, num, 100).collect())
    want = plain.classes(rows + more, n, num, 100)
    assert got == Counter(want)
    assert len({c for _, _, c in want}) < len(rows + more)


def test_members_are_linked_as_by_all_pairs():
    rng = random.Random(5)
    for num, den in ((90, 100), (1, 2), (4, 5), (1, 1)):
        sets = []
        for _ in range(60):
            base = rng.choice(sets) if sets and rng.random() < 0.7 else frozenset(rng.sample(range(300), rng.randrange(1, 140)))
            sets.append(frozenset((base - set(rng.sample(sorted(base), min(len(base) - 1, rng.randrange(4))))) | {rng.randrange(300)}))
        sets = sorted(set(sets), key=len)
        links = jaccard.link_members([np.array(sorted(s), np.uint64) for s in sets], num, den)
        assert all(den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) for a, b in links)
        root = list(range(len(sets)))

        def top(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            assert top(a) != top(b)  # a forest
            root[top(a)] = top(b)
        for a in range(len(sets)):
            for b in range(a):
                if den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    assert top(a) == top(b)


def test_shared_shingles_give_pairs_and_hot_ones_chains(monkeypatch):
    monkeypatch.setattr(jaccard, "LIST", 4)
    rows = [(1, 10, g, 0) for g in (1, 2, 3)] + [(2, 10 + g, g, 0) for g in range(20, 60)] + [(3, 5, 7, 0), (3, 50, 8, 0), (4, 9, 1, 0)]
    for step in (1, 7, 100):  # however the rows are cut into batches
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i:i + step])], ["token", "size", "g", "at"]) for i in range(0, len(rows), step)]
        got = [tuple(r.values()) for b in jaccard.candidate_pairs(iter(batches), 80, 100) for r in b.to_pylist()]
        assert {(a, b) for a, b, _, _ in got} == {(1, 2), (1, 3), (2, 3)} | {(g, g + 1) for g in range(20, 59)}


def test_a_common_shingle_makes_no_pairs_of_all():
    n = 30_000
    batch = pa.RecordBatch.from_arrays([pa.array(np.full(n, 5)), pa.array(np.full(n, 40)), pa.array(np.arange(n)), pa.array(np.zeros(n, int))], ["token", "size", "g", "at"])
    assert sum(b.num_rows for b in jaccard.candidate_pairs(iter([batch]), 90, 100)) == n - 1


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 500 + i) for i in range(1, 300)] + [(900, 900), (901, None), (903, 902), (902, 903)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(201)} | {i: 500 for i in range(500, 800)} | {902: 902, 903: 902}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_duplicates_in_an_empty_table(spark, empty):
    assert jaccard.classes_of(empty).count() == 0
    assert repeats.without_repeats(empty).count() == 0


def test_smallest_of_each_stretch():
    rng = np.random.default_rng(1)
    g = rng.integers(0, 9, 300).astype(np.uint64)
    for n in (1, 2, 3, 8, 13, 28, 300, 301):
        want = [i + int(np.argmin(g[i:i + n])) for i in range(len(g) - n + 1)]
        assert repeats.smallest(g, n).tolist() == want


@pytest.mark.parametrize("window,part", [(35, 20_000), (35, 2), (12, 20_000), (5, 1), (1, 20_000)])
def test_repeated_passages_go(spark, docs, rows, window, part, monkeypatch):
    monkeypatch.setattr(repeats, "PART", part)
    monkeypatch.setattr(repeats, "SHARD_BYTES", 5000)
    got = repeats.attach(docs, repeats.without_repeats(docs, window))
    assert got.columns.count("kept") == 1 and "slot" in got.columns
    want = Counter((i, *r) for (i, _), r in zip(rows, plain.without_repeats([t for _, t in rows], window)))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got.collect()) == want
    assert any(removed for _, _, removed, _ in want)


def test_what_the_automaton_misses_stays(spark, monkeypatch):
    passages = [" ".join(f"{c}{i}" for i in range(20)) for c in "ab"]
    df = spark.createDataFrame([(i, f"x{i} {passages[i % 2]} y{i}") for i in range(6)], "doc_id int, text string")
    confirm = repeats.confirm
    for least, left in ((0, []), (25, [0, 1, 2, 3, 4, 5])):
        monkeypatch.setattr(repeats, "confirm", lambda *a, least=least: {p for p in confirm(*a) if len(p) >= least})
        rows = repeats.attach(df, repeats.without_repeats(df, 10)).collect()
        assert sorted(r.doc_id for r in rows if not r.n_removed) == left


def test_places_and_spans_meet_once_per_segment(spark, monkeypatch):
    line = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(i, f"{line} {line} {line} z{i}") for i in range(40)], "doc_id int, text string")
    joined = []
    join = type(df).join
    monkeypatch.setattr(type(df), "join", lambda a, b, on=None, *more: joined.append((a, on, out := join(a, b, on, *more))) or out)
    got = repeats.without_repeats(df, 10).collect()
    assert all(r.n_words == 37 and r.n_removed == 36 for r in got)
    (places, _, out), = [j for j in joined if j[1] == ["shard", "s1", "s2"]]
    assert out.count() <= places.count()


def test_chained_overlaps_are_judged_window_by_window(spark):
    w = [f"t{i}" for i in range(60)]
    texts = [" ".join(w), " ".join(w[:30]) + " x", "y " + " ".join(w[20:50]), " ".join(w[40:])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.n_removed, r.kept) for r in repeats.attach(df, repeats.without_repeats(df, 10)).collect()}
    assert got == {i: r[1:] for i, r in enumerate(plain.without_repeats(texts, 10))}


def test_sketches_keep_hashes_below_the_fraction(spark, docs, rows):
    full = sketch.with_sketch(docs, out="full", scale=1)
    both = sketch.with_sketch(full, out="slot").collect()
    for r in both:
        n = len({tuple(w) for w in [plain.words(r.text)[i:i + 5] for i in range(max(1, len(plain.words(r.text)) - 4))] if w})
        assert len(r.full) == n == len(set(r.full))
        below = sorted(h for h in r.full if h < -(2**63) + 2**64 // sketch.SCALE)
        assert list(r.slot) == (below or r.full[:1])
    assert len({tuple(r.slot) for r in both if r.text == rows[6][1]}) == 1


def test_sketches_merge_and_estimate(spark):
    a, b = " ".join(f"a{i}" for i in range(4000)), " ".join(f"a{i}" for i in range(1000))
    df = spark.createDataFrame([(a, b, "")], "a string, b string, none string")
    for c in df.columns:
        df = sketch.with_sketch(df, c, f"s_{c}")
    r = df.select(sketch.likeness(F.col("s_a"), F.col("s_b")).alias("like"),
                  sketch.containment(F.col("s_b"), F.col("s_a")).alias("inside"), sketch.containment(F.col("s_a"), F.col("s_b")).alias("share"),
                  sketch.likeness(F.col("s_none"), F.col("s_none")).alias("none"), sketch.likeness(F.col("s_a"), F.col("s_none")).alias("unlike"),
                  (sketch.merged(F.col("s_a"), F.col("s_b")) == F.col("s_a")).alias("merged"),
                  (sketch.merged(F.col("s_none"), F.col("s_b")) == F.col("s_b")).alias("same")).first()
    assert abs(r.like - 996 / 3996) < 0.05 and r.inside == 1.0 and abs(r.share - 996 / 3996) < 0.05
    assert (r.none, r.unlike) == (1.0, 0.0) and r.merged and r.same


def test_next_rows_in_key_order(spark, rows):
    one_text_an_id = {i: t for i, t in rows if i is not None}
    keys = sorted(one_text_an_id)
    df = spark.createDataFrame(sorted(one_text_an_id.items(), key=lambda r: str(r[1])), "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.next_text for r in with_next(df, "doc_id", ["text"]).collect()}
    assert got == {k: one_text_an_id[n] for k, n in zip(keys, keys[1:] + keys[:1])}
    assert with_next(df.limit(1), "doc_id", ["text"]).select((F.col("text").eqNullSafe(F.col("next_text")))).first()[0]
    assert with_next(df.limit(0), "doc_id", ["text"]).count() == 0
    many = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d"), (2, None)], "doc_id long, text string")
    pairs = [(r.doc_id, r.text, r.next_text) for r in with_next(many, "doc_id", ["text"]).collect()]
    assert len(pairs) == 5 and sorted(str(p[1]) for p in pairs) == sorted(str(p[2]) for p in pairs)


def test_ranges_follow_the_keys(spark):
    df = spark.createDataFrame([(i,) for i in [None, 5, 5, 5, *range(10, 1000, 7)]], "k long")
    got = sorted(((r.k is not None, r.k or 0), r.part) for r in df.withColumn("part", range_of(df, "k", 6)).collect())
    parts = [p for _, p in got]
    assert parts == sorted(parts) and set(parts) <= set(range(6)) and len(set(parts)) > 3
    assert len({p for (_, k), p in got if k == 5}) == 1


def test_recurring_anchors_are_looked_up_not_multiplied(spark, monkeypatch):
    """A passage that many texts share: the lookup of recurring anchors gives no row more than there are windows' anchors."""
    from nightwarden.llm import repeats

    plans, write = [], repeats.cut_lineage
    monkeypatch.setattr(repeats, "cut_lineage", lambda df, *by: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df, *by))[1])
    passage = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(i, f"a{i} {passage} b{i}") for i in range(40)], "doc_id long, text string")
    assert {r.n_removed for r in repeats.without_repeats(docs).collect()} == {50}
    joins = [line for plan in plans for line in plan.splitlines() if "Join" in line and "anchor" in line]
    assert joins and all("LeftSemi" in line for line in joins)


def test_a_passage_that_many_texts_share_is_looked_up_by_block(spark, monkeypatch):
    """Recurring anchors come back once for each block, not once for each text, and the texts' rows aren't multiplied by them."""
    passage = " ".join(f"w{i}" for i in range(50))
    counts, plans, write = {}, [], repeats.cut_lineage

    def written(df, *by):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        out = write(df, *by)
        counts[many].append((out.columns, out.count()))
        return out

    monkeypatch.setattr(repeats, "cut_lineage", written)
    for many in (150, 600):
        counts[many] = []
        docs = spark.createDataFrame([(i, f"a{i} {passage} b{i}") for i in range(many)], "doc_id long, text string")
        assert {r.n_removed for r in repeats.without_repeats(docs).collect()} == {50}
    blocks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    (anchors,), (near,) = ([n for columns, n in counts[600] if columns == c] for c in (["anchor"], ["block", "anchor"]))
    assert near <= blocks * anchors and near < 600
    assert not any("Generate" in plan for plan in plans)
