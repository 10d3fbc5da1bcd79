"""Suffix-tree scores and the quality classifier."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nightwarden.llm import blocks, quality, suffix_tree

from . import plain


@pytest.mark.parametrize("share", [1e-5, 2e-3])
def test_scores_equal_the_definition(spark, docs, rows, share, monkeypatch):
    monkeypatch.setattr(suffix_tree, "SHARE", share)
    monkeypatch.setattr(suffix_tree, "PRIORS", (20.0, 10.0))
    monkeypatch.setattr(suffix_tree, "CHUNK_BYTES", 2000)
    learn = [i is not None and plain.crc(i) % 7 != 2 for i, _ in rows]
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2  # null, so not learned from, without an id
    got = suffix_tree.score(docs, train).collect()
    want = plain.suffix_tree([t for _, t in rows], learn, share, suffix_tree.DIVERGENCE, (20.0, 10.0))

    def order(x):
        return (x[0] is None, x[0] or 0, x[2:])

    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=order)
    want = sorted(((i, not yes, *w) for (i, _), yes, w in zip(rows, learn, want)), key=order)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)
    assert all(r[6] < 0 for r in got)


def test_a_state_is_kept_only_where_it_tells_more(spark):
    texts = ["p q " * 30] * 6 + ["x y", "x z", "x w"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_tree.score(df, F.lit(True)).collect()}
    assert got[0].score > got[0].base_score


def test_a_hot_pair_is_a_few_entries_per_block():
    symbols = np.tile([0, 1], 50000)
    blob = blocks.pack(np.array([7]), np.ones(1, np.uint8), np.ones(1, np.uint8), np.array([len(symbols)]), blocks.narrow(symbols))
    counted = blocks.pack(np.array([0, 1], np.uint8), np.array([1, 2], np.uint8), np.array([50000, 50000]))
    x = suffix_tree.Block(iter([{"kind": 0, "blob": blob}, {"kind": 1, "blob": counted}]), 1, 100001, 64)
    a, b, n, pair, ask, bucket = x.pairs(2)
    assert sorted(zip(a.tolist(), b.tolist(), n.tolist())) == [(0, 1, 50000), (1, 0, 49999), (1, 2, 1), (2, 0, 1)]
    assert len(pair) == 100001 and len(ask) == 3  # a context seen once is too rare to be asked for
    word, home = x.starters(2)  # half of all tokens: spread over half of the buckets
    assert [(word == i).sum() for i in (0, 1)] == [32, 32] and (np.diff(home) >= 0).all()


def test_scores_do_not_depend_on_the_number_of_buckets(spark, docs, monkeypatch):
    monkeypatch.setattr(suffix_tree, "PRIORS", (20.0, 10.0))
    train = F.col("doc_id") % 3 > 0
    want = sorted((r.score for r in suffix_tree.score(docs, train).collect()))
    monkeypatch.setattr(suffix_tree, "BUCKET_TOKENS", 100)
    monkeypatch.setattr(suffix_tree, "CHUNK_BYTES", 3000)
    assert np.allclose(sorted(r.score for r in suffix_tree.score(docs, train).collect()), want, rtol=1e-9)


def test_a_context_counts_as_much_in_a_larger_corpus(spark):
    rare = [(i, "qa qb qc qd") for i in range(6)]
    more = [(100 + i, " ".join(f"w{(i * 7919 + j * j) % 997}" for j in range(2000))) for i in range(400)]
    few = {r.doc_id: r for r in suffix_tree.score(spark.createDataFrame(rare + more[:20], "doc_id long, text string"), F.lit(True)).collect()}
    many = {r.doc_id: r for r in suffix_tree.score(spark.createDataFrame(rare + more, "doc_id long, text string"), F.lit(True)).collect()}
    assert many[0].train_tokens > 800000  # 1e-5 of these are more than the six times that each context occurs
    assert few[0].score > few[0].base_score + 1 and many[0].score > many[0].base_score + 1


def test_answers_about_triples_are_small_numbers_without_the_documents(spark, monkeypatch):
    written, cut = [], suffix_tree.cut_lineage
    monkeypatch.setattr(suffix_tree, "cut_lineage", lambda df, **more: written.append(cut(df, **more)) or written[-1])
    texts = [(i, " ".join(f"w{(i * 7919 + j * j) % 97}" for j in range(1000))) for i in range(100)]
    got = suffix_tree.score(spark.createDataFrame(texts, "doc_id long, text string"), F.lit(True)).agg(F.sum("n_tokens")).first()[0]
    last = {r.kind: r.size for r in written[-1].groupBy("kind").agg(F.sum(F.octet_length("blob")).alias("size")).collect()}
    assert got == 100100 and list(last) == [suffix_tree._TRIPLES] and 0 < last[suffix_tree._TRIPLES] < 2 * got


def test_scores_without_training_rows_and_without_rows(spark, docs, empty):
    assert {r.base_score for r in suffix_tree.score(docs, F.lit(False)).collect()} == {0.0}
    got = suffix_tree.score(empty, F.lit(True))
    assert got.count() == 0 and got.columns[0] == "doc_id"


def junk(i):
    return [" | ".join(f"ab{i}c{j}" for j in range(20)), "word " * 40, "LOUD!! TEXT!! " * 10][i % 3]


def test_classifier_tells_junk_from_prose_on_held_out_rows(spark):
    prose = plain.hard_texts(7, 400)[20:]
    rows = [(i, prose[i % len(prose)] + f" end{i}" if i % 4 else junk(i), int(i % 4 > 0)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    forest = quality.train(df.select("doc_id", "text"), df.select("doc_id", "quality"), learn=learn)
    held = quality.with_score(df, forest).where(~learn).collect()
    assert np.mean([(r.score >= 0.7) == r.quality for r in held]) > 0.97


def test_only_the_fit_is_in_one_task(spark):
    rows = [(i, ["good text of words", "again again again"][i % 2] + f" {i}") for i in range(60)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 7), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int").coalesce(1)
    sc = spark.sparkContext
    sc.setJobGroup("fit", "fit")
    try:
        quality.train(df, labels)
    finally:
        sc.setJobGroup("", "")
    tracker = sc.statusTracker()
    stages = [s for j in tracker.getJobIdsForGroup("fit") for s in tracker.getJobInfo(j).stageIds]
    assert 7 in {info.numTasks for info in map(tracker.getStageInfo, stages) if info}


def test_trees_walk_as_they_are_built():
    rng = np.random.default_rng(1)
    x = rng.random((600, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    forest = quality.fit(x, y)

    def walk(row):
        total = forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.right[node] if row[forest.feature[node]] > forest.threshold[node] else forest.left[node]
            total += forest.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(x[:50]), [walk(r) for r in x[:50]])
    assert ((forest.score(x) > 0.5) == y).mean() > 0.97


def test_statistics_of_a_text():
    data, offsets = blocks.utf8(pa.array(["Ab ab, AB! 1\nx", "", None], pa.string()))
    s = dict(zip(quality.STATISTICS, quality.statistics(data, offsets)[0]))
    assert s["share_upper"] == 3 / 14 and s["share_digit"] == 1 / 14 and s["distinct"] == 5 / 5 and s["words_per_line"] == 5 / 2
    assert s["stop_end"] == 1 / 5 and s["mark_end"] == 1 / 5
    assert not quality.statistics(data, offsets)[1:, :-1][:, :21].any()


def test_classifier_edge_cases(spark, docs, rows, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    scored = quality.with_score(docs, quality.train(docs, none))
    assert {r.score for r in scored.collect()} == {0.5} and scored.count() == len(rows) and scored.columns.count("score") == 1
    one = spark.createDataFrame([(rows[3][0], 1), (rows[3][0], 1), (None, 0), (rows[4][0], None)], "doc_id long, quality int")
    assert {r.score for r in quality.with_score(docs, quality.train(docs, one)).collect()} == {1.0}
    assert quality.with_score(empty, quality.train(empty, none)).count() == 0


def test_shuffle_files_leave_the_disk_when_a_result_is_written(spark):
    from nightwarden.session import cut_lineage

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        names = []
        while files.hasNext():
            names.append(files.next().getName())
        return {n for n in names if n.startswith("shuffle_")}

    df = spark.range(1000).repartition(3, "id")
    before = shuffled()
    assert cut_lineage(df, release=True).count() == 1000
    released = {n for n in shuffled() - before if n.endswith(".data")}
    assert cut_lineage(df).count() == 1000
    kept = {n for n in shuffled() - before - released if n.endswith(".data")}
    assert len(released) < len(kept)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
