"""Streams give what the batch operators give."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from nightwarden.catalog import streams
from nightwarden.operators import rules as ru
from nightwarden.plans.analysis import AnalysisConfig
from nightwarden.schema import EVENT_SCHEMA
from nightwarden.streaming import detect as sd
from nightwarden.streaming import ordered as so

from . import helpers as h

RULE = ru.parse_rule({"title": "t", "detection": {
    "selection": {"status": "failure"}, "timeframe": "60s", "condition": "selection | count() >= 3"}}, "t")


CLOSING = [h.failure(ip="end", at=10**8)]  # its time closes all that is open


def write_parts(spark, folder, parts):
    """One parquet folder per part, in arrival order."""
    seq = 0
    for i, rows in enumerate(parts):
        for r in rows:
            r["seq"] = seq
            seq += 1
        h.events(spark, rows).coalesce(1).write.mode("append").parquet(f"{folder}/p")


def read_stream(spark, folder):
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/p")


def test_count_state_carries_over_files(spark, tmp_path):
    write_parts(spark, str(tmp_path), [
        [h.failure(at=0), h.failure(at=10), h.failure(ip="2.2.2.2", at=5)],
        [h.failure(at=55), h.failure(at=56), h.failure(ip="2.2.2.2", at=70)],
        [h.failure(at=58), h.failure(at=59), h.failure(at=200)],
        CLOSING,
    ])
    out = str(tmp_path / "out")
    query = sd.to_table(so.count_alerts(read_stream(spark, tmp_path), RULE, delay="1 hour"), out, f"{out}-cp")
    query.awaitTermination()
    got = h.rows(spark.read.parquet(out), "source_ip", "seq_lo", "seq_hi", "n_events")
    batch = ru.count_evidence(spark.read.parquet(str(tmp_path / "p")), RULE)
    alerts = ru.to_alerts(batch, ru.rules_table(spark, [RULE]))
    want = sorted((k.split("|")[1], *r) for k, *r in h.rows(alerts, "key_value", "seq_lo", "seq_hi", "n_events"))
    assert got == want and len(got) == 2


def arrivals(seed, n=400, files=5):
    """Rows in time order, dealt to files with some of them late, and the closing row; (files, rows in order of time and seq)."""
    rng = random.Random(seed)
    at, rows = 0, []
    for _ in range(n):
        at += rng.choice([0, 1, 5, 20, 90])
        make = h.failure if rng.random() < 0.8 else h.success
        rows.append(make(ip=rng.choice(["1.1.1.1", "1.1.1.1", "2.2.2.2"]), user=f"u{rng.randrange(6)}", at=at))
    parts = [[] for _ in range(files)]
    for i, r in enumerate(rows):
        parts[min(files - 1, i * files // n + (rng.random() < 0.2))].append(r)
    for p in parts:
        rng.shuffle(p)
    return [*parts, CLOSING]


@pytest.mark.parametrize("seed,slice_s", [(1, 60), (2, 7), (3, 100_000)])
def test_detectors_on_streams_equal_their_definitions(spark, tmp_path, seed, slice_s):
    parts = arrivals(seed)
    write_parts(spark, str(tmp_path), parts)
    mine, width = {}, 120
    for r in sorted((r for p in parts for r in p), key=lambda r: (r["at"], r["seq"])):
        mine.setdefault(r["source_ip"], []).append(r)
    span = timedelta(seconds=slice_s)
    delay = f"{max(r['at'] for r in parts[-2])} seconds"
    runs = {
        "enum": (so.enum_alerts(read_stream(spark, tmp_path), 4, delay, span),
                 lambda rs: h.loop_distinct([(r["username"], r["seq"]) for r in rs if r["status"] == "failure"], 4)),
        "stuffing": (so.stuffing_alerts(read_stream(spark, tmp_path), 3, timedelta(seconds=width), delay, span),
                     lambda rs: h.loop_stuffing([(h.US0 + r["at"] * 10**6, r["seq"], r["status"] == "failure") for r in rs], 3, width * 10**6)),
        "count": (so.count_alerts(read_stream(spark, tmp_path), RULE, delay=delay, slice=span),
                  lambda rs: h.loop_count([(r["at"], r["seq"]) for r in rs if r["status"] == "failure"], 3, 60)),
    }
    for name, (stream, loop) in runs.items():
        out = str(tmp_path / name)
        sd.to_table(stream, out, f"{out}-cp").awaitTermination()
        got = h.rows(spark.read.parquet(out), "source_ip", "seq_lo", "seq_hi", "n_events")
        want = sorted((ip, *f) for ip, rs in mine.items() for f in loop(rs))
        assert got == want and len(want) > 10


def test_state_holds_slices_and_shrinks(spark, tmp_path):
    """Rows of a key wait by slice; once all has been decided, only what the next row needs is kept."""
    write_parts(spark, str(tmp_path), [[h.failure(at=i, user=f"u{i % 3}") for i in range(300)], [h.failure(at=i, user="u1") for i in range(300, 600)], CLOSING])
    out = str(tmp_path / "out")
    query = sd.to_table(so.stuffing_alerts(read_stream(spark, tmp_path), 10, timedelta(seconds=60), "10 seconds", timedelta(seconds=5)), out, f"{out}-cp")
    query.awaitTermination()
    rows = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    assert max(rows) > 60 and rows[-1] <= 60 and spark.read.parquet(out).count() == 0


def test_rows_behind_the_watermark_are_counted(spark, tmp_path):
    write_parts(spark, str(tmp_path), [[h.failure(at=a) for a in (0, 1)], [h.failure(at=5000)], [h.failure(at=5001)], [h.failure(at=2), h.failure(at=5002)], CLOSING])
    out = str(tmp_path / "out")
    query = sd.to_table(so.count_alerts(read_stream(spark, tmp_path), RULE, delay="1 minute"), out, f"{out}-cp")
    query.awaitTermination()
    assert sd.late_rows(query) == 1
    assert h.rows(spark.read.parquet(out), "seq_lo", "seq_hi", "n_events") == [(2, 5, 3)]  # without the late row, seq 4


def test_dedup_over_files_and_late_rows(spark, tmp_path):
    hits = [{"at": 0, "event_id": 4698}, {"at": 30, "event_id": 4698}, {"at": 60, "event_id": 4698}]
    write_parts(spark, str(tmp_path), [[dict(r) for r in hits], [dict(r) for r in hits], [{"at": 7200, "event_id": 4698}],
                                       [{"at": 7230, "event_id": 4698}], [{"at": 1, "event_id": 4698}]])
    rules = [r for r in ru.load_rules()[0] if r.id == "win-schtask-001"]
    out = str(tmp_path / "out")
    query = sd.to_table(sd.dedup_hits(sd.rule_hits(read_stream(spark, tmp_path), rules)), out, f"{out}-cp")
    query.awaitTermination()
    minutes = sorted(str(r.minute)[11:16] for r in spark.read.parquet(out).collect())
    assert minutes == ["02:30", "02:31", "04:30"]
    assert sd.late_rows(query) == 1


def test_watch_analyzes_each_file_alone(spark, tmp_path):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    body = "sshd[1]: Failed password for u{} from 9.9.9.9 port 1 ssh2"
    for name, n in (("a.log", 12), ("b.log", 9), ("c.txt", 12)):
        (folder / name).write_text("\n".join(f"Jun 15 12:30:{i:02d} web1 " + body.format(i % 2) for i in range(n)))
    config = AnalysisConfig(rules=[r for r in ru.load_rules()[0] if r.id == "sudo-root-001"], use_anomaly=False)
    sd.watch(spark, str(folder), str(out), str(tmp_path / "cp"), config=config).awaitTermination()
    alerts = spark.read.parquet(str(out / "alerts")).collect()
    assert [(r.rule_id, r.n_events) for r in alerts] == [("threshold_brute_force_ip", 12)]
    totals = spark.read.parquet(str(out / "summary")).collect()
    assert sorted(r.events_processed for r in totals) == [9, 12]


def test_windows_and_sessions_close_with_the_watermark(spark, tmp_path):
    rows = [{"at": a, "hostname": "h"} for a in (0, 10, 4000, 4010, 20_000)]
    write_parts(spark, str(tmp_path), [rows])
    out = str(tmp_path / "s")
    sd.to_table(sd.sessions(read_stream(spark, tmp_path)), out, f"{out}-cp").awaitTermination()
    assert sorted(r.n_events for r in spark.read.parquet(out).collect()) == [2, 2]
    out = str(tmp_path / "w")
    sd.to_table(sd.sliding_counts(read_stream(spark, tmp_path), "hostname"), out, f"{out}-cp").awaitTermination()
    counts = spark.read.parquet(out).agg(F.max("n_events"), F.sum("n_events")).first()
    assert tuple(counts) == (2, 20)


@pytest.mark.parametrize("parts", [1, 3])
def test_numbered_lines_are_unique_in_a_batch(spark, parts):
    lines = spark.range(10).select(F.col("id").cast("string").alias("value")).repartition(parts)
    assert sd.numbered(lines).select("seq").distinct().count() == 10


def test_rows_without_a_time_do_not_stop_a_count(spark, tmp_path):
    write_parts(spark, str(tmp_path), [[h.failure(at=0), h.failure(at=None), h.failure(at=10)], [h.failure(at=None), h.failure(at=20)], CLOSING])
    out = str(tmp_path / "out")
    sd.to_table(so.count_alerts(read_stream(spark, tmp_path), RULE, delay="1 hour"), out, f"{out}-cp").awaitTermination()
    assert [r.n_events for r in spark.read.parquet(out).collect()] == [3]
    assert [r["rows"] for r in sd.untimed(spark.read.parquet(str(tmp_path / "p"))).collect()] == [2]


def test_files_of_a_stream_are_cut_without_a_buffer_of_all_times(spark, tmp_path, monkeypatch):
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=7 * i), i % 5, "error", 1.0, '{"k": 1}') for i in range(41)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(streams.F, "percentile", None)
    stream, delay = streams.arriving(spark, str(tmp_path))
    assert stream.isStreaming and delay == f"{2 * 10 * 7 * 60 + 1} seconds"


def test_state_stores_share_a_bounded_memory(spark):
    """However many partitions an executor holds open."""
    stream = spark.readStream.format("rate").load().select(
        F.col("timestamp").alias("ts"), F.lit(0).alias("us"), F.col("value").alias("seq"), F.lit("").alias("mark"), F.lit("k").alias("k"))
    so.fired(stream, ["k"], so.Counting(1, 2, 3))
    assert spark.conf.get("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage") == "true"
