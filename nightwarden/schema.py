"""The normalized event and alert schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("id", T.StringType()),
    T.StructField("source_type", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("hostname", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("ts_ok", T.BooleanType()),
    T.StructField("event_id", T.IntegerType()),
    T.StructField("channel", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("username", T.StringType()),
    T.StructField("source_ip", T.StringType()),
    T.StructField("dest_ip", T.StringType()),
    T.StructField("process_name", T.StringType()),
    T.StructField("process_id", T.LongType()),
    T.StructField("parent_process", T.StringType()),
    T.StructField("command_line", T.StringType()),
    T.StructField("logon_type", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("raw", T.MapType(T.StringType(), T.StringType())),
    T.StructField("tags", T.ArrayType(T.StringType())),
])

# Event categories.
CATEGORIES = ["authentication", "process", "network", "file", "registry", "system", "audit", "unknown"]

UNKNOWN_HOST = "unknown"

ALERT_COLUMNS = [
    "alert_id", "rule_id", "rule_name", "rule_source", "src_rank", "rule_ord", "description",
    "severity", "weight", "ts", "us", "score", "techniques", "tactics", "status",
    "key_kind", "key_value", "mark", "seq_lo", "seq_hi", "n_events", "first_host",
]

# Total order of alerts: time, then detector family, then rule, then the event that completed it.
ALERT_ORDER = ["us", "src_rank", "rule_ord", "seq_hi", "key_value", "mark"]


def event_columns(**given: Column) -> list[Column]:
    """All event columns in schema order: the given ones, the rest NULL (tags: empty, host: unknown)."""
    out = []
    for field in EVENT_SCHEMA.fields:
        if field.name in given:
            col = given[field.name]
        elif field.name == "tags":
            col = F.array()
        else:
            col = F.lit(None)
        if field.name == "hostname":
            col = F.coalesce(col, F.lit(UNKNOWN_HOST))
        out.append(col.cast(field.dataType).alias(field.name))
    return out


def event_key(*parts: Column) -> Column:
    """Reproducible event id from its origin."""
    return F.substring(F.sha2(F.concat_ws("~", *[p.cast("string") for p in parts]), 256), 1, 32)


def with_micros(events: DataFrame) -> DataFrame:
    """Add us, the event time in microseconds, used for exact window arithmetic."""
    return events.withColumn("us", F.unix_micros("ts"))
