"""The pipeline's stages on a small folder of tables, each against a plain version; the queries' names and columns."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from nightwarden.llm import packing, quality, queries

from . import plain


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghi") for _ in range(rng.randrange(2, 9))) for _ in range(500)]

    def prose(k):
        return " ".join(rng.choice(vocabulary) for _ in range(k)) + "."

    passage, rows, marks = prose(70), [], []
    for i in range(300):
        good = i % 5 > 0
        text = prose(rng.randrange(90, 200)) if good else [" | ".join(prose(1) for _ in range(30)), "again " * 60, "NOISE!! " * 40][i % 3]
        rows.append((i, text + " " + passage if good and i % 7 == 0 else text, "en", "s", len(text)))
        marks.append((i, int(good), 0))
    rows += [(400 + i, rows[6 + 5 * i][1] + " tail", "en", "s", 1) for i in range(10)] + [rows[11], (500, rows[12][1], "en", "s", 1), (501, None, "en", "s", None)]
    where = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def test_stages_do_what_they_say(spark, folder, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    (_, stage_quality), (_, stage_near), (_, stage_repeats), (_, stage_pack) = corpus_pipeline.STAGES
    kept = stage_quality(spark, docs, folder).cache()
    assert kept.columns == docs.columns
    forest = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    want = quality.with_score(docs, forest).where("score >= 0.7").select(*docs.columns)
    assert Counter(map(tuple, kept.collect())) == Counter(map(tuple, want.collect()))
    ids = {r.doc_id for r in kept.collect()}
    assert sum(i % 5 > 0 for i in ids if i < 300) >= 235 and sum(i % 5 == 0 for i in ids if i < 300) <= 2

    one = stage_near(spark, kept, folder).cache()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    classes = plain.classes(rows, 5, 80, 100)
    want = {c for _, n, c in classes if n} | {i for i, n, _ in classes if not n}
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == sorted(want) and len(want) < len(rows)

    cut = stage_repeats(spark, one, folder).cache()
    before = [(r.doc_id, r.text, r.n_chars) for r in one.collect()]
    want = {}
    for (i, t, n), (_, removed, left) in zip(before, plain.without_repeats([t for _, t, _ in before], corpus_pipeline.WINDOW)):
        want[i] = (left, len(left)) if removed else (t, n)
    assert cut.columns == docs.columns and {r.doc_id: (r.text, r.n_chars) for r in cut.collect()} == want
    assert any(want[i] != (t, n) for i, t, n in before)

    packed = stage_pack(spark, cut, folder).collect()
    tokens = {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, (t, _) in want.items()}
    assert Counter({i: n for i, n in tokens.items()}) == sum((Counter({r.doc_id: r.length}) for r in packed), Counter())
    assert len({r.sequence_id for r in packed}) <= sum(tokens.values()) / 1024 * 1.1 + 1


def test_tiny_texts_fill_their_sequences(spark, tmp_path, library):
    rows = [(i, " a" * (i % 6), "en", "s", 1) for i in range(9000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    tokens = sum(len(library.encode(r[1], add_special_tokens=False).ids) + 1 for r in rows)
    for got in (corpus_pipeline.pack_sequences(spark, docs, str(tmp_path)), queries.QUERIES["op5_packing"](spark, str(tmp_path))):
        got = got.collect()
        assert len(got) == 9000 and len({r.sequence_id for r in got}) <= -(-tokens // 1024) * 1.01 + 1


def test_smaller_capacities_bind(spark):
    items = spark.createDataFrame([(i, 1 + i % 40) for i in range(3000)], "doc_id long, length long")
    for limits, value in (({"max_pieces": 7}, lambda lengths: len(lengths) <= 7), ({"max_cost": 9000}, lambda lengths: sum(n * n for n in lengths) <= 9000)):
        got = {}
        for r in packing.best_fit(items, limit=1024, **limits).collect():
            got.setdefault(r.sequence_id, []).append(r.length)
        assert all(map(value, got.values())) and len(got) > 3000 * 20.5 / 1024


def test_an_empty_table_stays_empty(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_copies_with_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c + " end"), (None, c + " tail"), (None, "x y z u v w"), (None, "x y z u v w"), (None, None), (8, " "), (8, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(map(tuple, corpus_pipeline.keep_one_of_near_copies(spark, docs, "").collect()))
    assert {k: n for k, n in got.items() if k[0] != 7} == {(3, a): 1, (5, b): 1, (None, "x y z u v w"): 1, (None, None): 1, (8, " "): 2}
    assert sum(n for k, n in got.items() if k[0] == 7) == 1


def test_the_whole_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.count() > 100 and {"doc_id", "sequence_id"} <= set(got.columns)


def test_the_queries_are_registered():
    names = set(entry.queries())
    assert {n: [q for q in names if re.match(rf"op{n}_", q)] for n in range(1, 14)} == {
        n: [q for q in queries.QUERIES if re.match(rf"op{n}_", q)] for n in range(1, 14)}
    assert len([q for q in names if re.match(r"op\d+_", q)]) == 13 and "pipeline" in names


COLUMNS = {
    1: "doc_id held_out n_tokens n_known train_tokens base_score score", 2: "doc_id n_tokens ids_sha256 decoded_sha256",
    3: "query_id rank vec_id score", 4: "doc_id held_out score predicted",
    5: "doc_id piece start length ids_crc32 sequence_id offset", 6: "doc_id start n_tokens ids_crc32",
    7: "doc_id size text_crc32 law shard slot grown_shard", 8: "doc_id n_shingles component_id", 9: "doc_id n_words n_removed kept_sha256",
    10: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next"}


@pytest.mark.parametrize("n", [n for n in COLUMNS if n != 3])
def test_query_rows_and_columns(spark, folder, n):
    name = next(q for q in queries.QUERIES if q.startswith(f"op{n}_"))
    got = queries.QUERIES[name](spark, folder)
    assert set(COLUMNS[n].split()) <= set(got.columns)
    rows = got.collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert Counter(r.doc_id for r in rows if n != 5 or r.piece == 0) == Counter(r.doc_id for r in docs)


def test_stages_send_texts_to_python_in_small_batches(spark, folder):
    """However wide the rows are; 10,000 of them are 10,000 texts."""
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], ["n", "size"])

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wide = spark.range(0, 600, 1, 1).select(F.repeat(F.lit("wide "), 8000).alias("text"))
    for name, stage in corpus_pipeline.STAGES:
        spark.conf.unset(setting)
        stage(spark, docs, folder)
        got = wide.mapInArrow(sizes, "n bigint, size bigint").collect()
        assert sum(r.n for r in got) == 600 and max(r.size for r in got) < 5 << 20, name
