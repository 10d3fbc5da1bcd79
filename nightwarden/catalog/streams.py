"""Queries that read the events table as a stream (H*), compared with the batch result."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules as ru
from ..operators.anomaly import percentiles
from ..session import scratch_path
from ..streaming import detect as sd
from ..streaming import ordered as so
from . import detectors as dt
from .fixture import from_events, table, with_ev
from .registry import ORACLES, query
from .rules import C13_SQL, EVERY_MATCH, count_rule


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = (
        spark.readStream.schema(table(spark, sf_dir, "events").schema)
        .option("pathGlobFilter", "events.parquet").parquet(sf_dir))
    return from_events(raw)


def run(stream: DataFrame, label: str) -> DataFrame:
    """Run the stream over what is there now; returns the table it wrote."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    sd.to_table(stream, path, f"{path}-checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


END = "9999-end-of-input"
DAY = timedelta(days=1)
FILES = 4


def end_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row whose time closes every window; its host and address are END."""
    schema = table(spark, sf_dir, "events").schema
    return spark.createDataFrame([(-1, datetime(2300, 1, 1), 0, "error", 0.0, '{"k": 0}')], schema)


def marked(ev: DataFrame) -> DataFrame:
    """Events with the end marker told apart from all others."""
    last = F.col("seq") == -1
    return ev.withColumns({c: F.when(last, END).otherwise(F.col(c)) for c in ("hostname", "source_ip")})


def arriving(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The events as FILES files in time order, one a micro-batch, and how late rows come: every fifth is a file late.

    The end marker is a file of its own.
    """
    rows = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = percentiles(rows.select(us.alias("us")), "us", [i / FILES for i in range(FILES + 1)])
    part = sum((us >= int(c)).cast("int") for c in cuts[1:-1])
    part = F.least(part + (F.col("event_id") % 5 == 0).cast("int"), F.lit(FILES - 1))
    path = scratch_path(spark, "arriving")
    for i in range(FILES):
        rows.filter(part == i).coalesce(1).write.mode("append").parquet(path)
    end_marker(spark, sf_dir).coalesce(1).write.mode("append").parquet(path)
    late = max(cuts[min(i + 2, FILES)] - cuts[i] for i in range(FILES))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return marked(from_events(stream)), f"{int(late // 1_000_000) + 1} seconds"


PLAIN = {r: w for r, w in EVERY_MATCH.items() if r not in ("ssh-brute-force-001", "win-failed-logon-001")}
HITS_SQL = "hits AS (" + " UNION ALL ".join(
    [f"SELECT '{r}' AS rule_id, seq, ts, hostname FROM ev WHERE {w}" for r, w in PLAIN.items()]
    + [f"SELECT 'threshold_after_hours_login', seq, ts, hostname FROM ev WHERE {dt.SUCCESS} AND NOT (hour(ts) >= 6 AND hour(ts) < 22)"]) + ")"


def _hits(spark, sf_dir) -> DataFrame:
    return sd.rule_hits(event_stream(spark, sf_dir), ru.load_rules()[0])


@query("stream_rules", with_ev(HITS_SQL, select="SELECT rule_id, seq, hostname FROM hits"))
def stream_rules(spark, sf_dir):
    """H1, H2: single-event rules and after-hours logins on a stream."""
    return run(_hits(spark, sf_dir), "stream-rules").select("rule_id", "seq", "hostname")


@query("stream_count", with_ev(C13_SQL, select="""
SELECT hostname, source_ip, us AS fired_us, lo AS seq_lo, hi AS seq_hi, n AS n_events FROM c13"""))
def stream_count(spark, sf_dir):
    """The counting rule with keyed state, over rows that arrive in several files and late."""
    stream, delay = arriving(spark, sf_dir)
    return run(so.count_alerts(stream, count_rule(), delay=delay, slice=DAY), "stream-count")


@query("stream_enum", with_ev(dt.D2_SQL, select="SELECT source_ip, us AS fired_us, lo AS seq_lo, hi AS seq_hi, n AS n_events FROM d2"))
def stream_enum(spark, sf_dir):
    """Account enumeration with keyed state, over rows that arrive in several files and late."""
    stream, delay = arriving(spark, sf_dir)
    return run(so.enum_alerts(stream, dt.CFG.enum_users, delay, DAY), "stream-enum")


@query("stream_stuffing", with_ev(dt.D3_SQL, select="SELECT source_ip, us AS fired_us, lo AS seq_lo, hi AS seq_hi, n AS n_events FROM d3"))
def stream_stuffing(spark, sf_dir):
    """H3, D3: credential stuffing with keyed state, over rows that arrive in several files and late."""
    stream, delay = arriving(spark, sf_dir)
    return run(so.stuffing_alerts(stream, dt.STUFFING.failures, dt.STUFFING.window, delay, DAY), "stream-stuffing")


@query("stream_dedup", with_ev(HITS_SQL, select="""
SELECT DISTINCT rule_id, hostname, date_trunc('minute', ts) AS minute FROM hits"""))
def stream_dedup(spark, sf_dir):
    """H5: one hit per rule, host and minute."""
    return run(sd.dedup_hits(_hits(spark, sf_dir)), "stream-dedup").select(
        "rule_id", "hostname", F.col("minute").cast("timestamp_ntz").alias("minute"))


def closed_stream(spark, sf_dir) -> DataFrame:
    """The events stream and the end marker."""
    path = scratch_path(spark, "end-of-input")
    marker = end_marker(spark, sf_dir)
    marker.coalesce(1).write.parquet(path)
    return event_stream(spark, sf_dir).unionByName(marked(from_events(spark.readStream.schema(marker.schema).parquet(path))))


@query("stream_windows", with_ev("""
w AS (SELECT hostname, unnest(generate_series(us // 3600000000 - 5, us // 3600000000)) * 3600000000 AS start_us FROM ev WHERE event_id = 4625)""",
    select="""
SELECT hostname, make_timestamp(start_us) AS window_start, make_timestamp(start_us + 21600000000) AS window_end, count(*) AS n_events
FROM w GROUP BY ALL"""))
def stream_windows(spark, sf_dir):
    """H4: failures per host in six-hour windows every hour, all of them once the input has ended."""
    failed = closed_stream(spark, sf_dir).filter("event_id = 4625")
    return run(sd.sliding_counts(failed, "hostname", "6 hours", "1 hour"), "stream-windows").filter(F.col("hostname") != END).select(
        "hostname", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        F.col("window_end").cast("timestamp_ntz").alias("window_end"), "n_events")


@query("stream_sessions", ORACLES["activity_sessions"])
def stream_sessions(spark, sf_dir):
    """H6: all bursts of activity per host, as the batch operator finds them."""
    return run(sd.sessions(closed_stream(spark, sf_dir)), "stream-sessions").filter(F.col("hostname") != END).select(
        "hostname", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"),
        F.col("last_seen").cast("timestamp_ntz").alias("last_seen"), "n_events")


@query("stream_foreach_file", with_ev(*dt.ALL_SQL, select=dt.ALL_OUT))
def stream_foreach_file(spark, sf_dir):
    """H7: every file that arrives goes through all batch detectors on its own."""
    path = scratch_path(spark, "stream-files")

    def handle(batch: DataFrame, batch_id: int) -> None:
        dt.detect_all(batch).alerts().write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    sd.per_batch(event_stream(spark, sf_dir), handle, f"{path}-checkpoint").awaitTermination()
    return dt.plain(spark.read.parquet(path))
