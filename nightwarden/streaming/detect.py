"""Structured Streaming forms of the operators (H1, H2, H4-H8, A7; H3 is in `ordered`). They use the batch Column builders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.predicates import is_success_auth
from ..operators import rules as ru
from ..plans.analysis import AnalysisConfig, analyze
from ..session import stages
from ..sources.lines import parse_lines

WATCH_PATTERNS = "*.log *.xml"


def stream_lines(
    spark: SparkSession, folder: str, patterns: str = WATCH_PATTERNS, files_per_trigger: int | None = None,
) -> DataFrame:
    """H1: lines of files that appear in a folder (top level), whose names match one of the space-separated globs.

    The checkpoint of the query that reads this remembers the files taken, so a restart repeats and skips none.
    """
    reader = spark.readStream.format("text").option("pathGlobFilter", "{" + ",".join(patterns.split()) + "}")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder).select(
        "value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_name").alias("file_name"))


def numbered(batch: DataFrame) -> DataFrame:
    """Give the lines of a micro-batch a seq that is unique in the batch and follows line order inside a file.

    Event ids also carry the file's name, so they differ between batches.
    """
    return batch.withColumn("seq", F.monotonically_increasing_id())


def rule_hits(events: DataFrame, rules: list[ru.Rule], work_hours: tuple[int, int] = (6, 22)) -> DataFrame:
    """H2: rules that look at one event, and after-hours logins, row by row on a stream."""
    plain = [r for r in rules if not r.counts]
    ids = F.array(*[F.lit(r.id) for r in plain])
    hits = ru.match_rules(events, plain).select(
        F.element_at(ids, F.col("rule_ord") + 1).alias("rule_id"), "seq", "ts", "hostname", "username", "source_ip")
    late = events.filter(is_success_auth() & ~F.hour("ts").between(work_hours[0], work_hours[1] - 1)).select(
        F.lit("threshold_after_hours_login").alias("rule_id"), "seq", "ts", "hostname", "username", "source_ip")
    return hits.unionByName(late)


def untimed(events: DataFrame) -> DataFrame:
    """How many rows per file have no readable time, so that windows and counting rules can't place them."""
    return events.filter("ts IS NULL").groupBy("source_file").agg(F.count("*").alias("rows"))


def sliding_counts(
    events: DataFrame, key: str, window: str = "5 minutes", slide: str = "1 minute", delay: str = "10 minutes",
) -> DataFrame:
    """H4: events per key in sliding windows at fixed starts: an approximation of the anchored windows of D1, D6, D7."""
    return (
        events.withWatermark("ts", delay).groupBy(F.window("ts", window, slide), key).agg(F.count("*").alias("n_events"))
        .select(key, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n_events"))


def dedup_hits(hits: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """H5: one hit per rule, host and minute on a stream (the first to arrive)."""
    return (
        hits.withWatermark("ts", delay).withColumn("minute", F.date_trunc("minute", "ts"))
        .dropDuplicatesWithinWatermark(["rule_id", "hostname", "minute"]))


def sessions(events: DataFrame, key: str = "hostname", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """H6: bursts of activity per key, split at pauses of `gap`."""
    return (
        events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), key)
        .agg(F.count("*").alias("n_events"), F.max("ts").alias("last_seen"))
        .select(key, F.col("session_window.start").alias("first_seen"), "last_seen", "n_events"))


def per_batch(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True,
    interval: str = "1 minute",
) -> StreamingQuery:
    """Run handle(batch, batch_id) on every micro-batch."""
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger).start())


def watch(
    spark: SparkSession, folder: str, out: str, checkpoint: str, patterns: str = WATCH_PATTERNS,
    config: AnalysisConfig | None = None, available_now: bool = True, **auth_options,
) -> StreamingQuery:
    """Analyze every new file on its own and write its alerts, incidents and summary below out.

    One file per micro-batch, so no state or key is shared between files. A batch that is repeated after a failure
    overwrites its own folder.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        with stages(batch.sparkSession):
            result = analyze(parse_lines(numbered(batch), **auth_options), config)
            for name, df in result.tables().items():
                df.write.mode("overwrite").parquet(f"{out.rstrip('/')}/{name}/batch={batch_id}")

    return per_batch(stream_lines(spark, folder, patterns, files_per_trigger=1), handle, checkpoint, available_now)


def to_table(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream's finished rows to a parquet table and stop when the input present now is used up."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def late_rows(query: StreamingQuery) -> int:
    """H8: rows the watermark has dropped so far."""
    return sum(
        op.numRowsDroppedByWatermark for progress in query.recentProgress for op in progress.stateOperators)
