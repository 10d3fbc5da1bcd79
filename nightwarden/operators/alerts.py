"""Alert tables: building, ordering, de-duplication, indicators, summaries."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import severity_weight
from ..schema import ALERT_COLUMNS, UNKNOWN_HOST
from ..session import cut_released
from .ordered import first_rows

# What an alert's evidence keeps of each event.
EVIDENCE_EVENT_COLUMNS = ["seq", "us", "hostname", "username", "source_ip", "category", "command_line"]
EVIDENCE_COLUMNS = ["rule_id", "key_kind", "key_value", "mark", *EVIDENCE_EVENT_COLUMNS]
ALERT_KEY = ["rule_id", "key_value", "mark"]

# Order of the detector families in a result.
SOURCE_RANK = {"sigma": 0, "threshold": 1, "ml_anomaly": 2}


def alert_id() -> Column:
    """Reproducible id from what makes an alert unique: rule, key and completing position."""
    text = F.concat_ws("~", "rule_id", "key_value", F.col("mark").cast("string"))
    return F.substring(F.sha2(text, 256), 1, 32)


def evidence(rows: DataFrame, rule_id: str | Column, key_kind: str, key_value: Column, mark: Column) -> DataFrame:
    """Tag event rows with the alert they belong to."""
    return rows.select(
        (F.lit(rule_id) if isinstance(rule_id, str) else rule_id).alias("rule_id"),
        F.lit(key_kind).alias("key_kind"),
        key_value.alias("key_value"),
        mark.cast("long").alias("mark"),
        *EVIDENCE_EVENT_COLUMNS,
    )


def roll_up(tagged: DataFrame, *extra: Column) -> DataFrame:
    """One row per alert from its evidence rows; aggregates partially before the shuffle."""
    return _ends(tagged.groupBy("rule_id", "key_kind", "key_value", "mark").agg(
        F.count("*").alias("n_events"), F.min(F.struct("us", "seq", "hostname")).alias("__first"),
        F.max(F.struct("us", "seq")).alias("__last"), *extra))


def roll_up_ranges(ranges: DataFrame, rows: DataFrame, rule_id: str, key_kind: str, key: str) -> DataFrame:
    """What roll_up makes of the rows ranked first to last of each range (key, mark, first, last), from two rows of each."""
    first = rows.select(key, F.col("rank").alias("first"), F.struct("us", "seq", "hostname").alias("__first"))
    last = rows.select(key, F.col("rank").alias("last"), F.struct("us", "seq").alias("__last"))
    ends = ranges.join(first, [key, "first"]).join(last, [key, "last"]).select(
        F.lit(rule_id).alias("rule_id"), F.lit(key_kind).alias("key_kind"), F.col(key).alias("key_value"), "mark",
        (F.col("last") - F.col("first") + 1).alias("__n"), "__first", "__last")
    return _ends(ends.groupBy("rule_id", "key_kind", "key_value", "mark").agg(
        F.sum("__n").alias("n_events"), F.min("__first").alias("__first"), F.max("__last").alias("__last")))


def _ends(rolled: DataFrame) -> DataFrame:
    return rolled.withColumns({
        "us": F.col("__last.us"),
        "seq_lo": F.col("__first.seq"),
        "seq_hi": F.col("__last.seq"),
        "first_host": F.col("__first.hostname"),
    }).drop("__first", "__last")


def complete(
    rolled: DataFrame,
    *,
    rule_name: Column,
    rule_source: str,
    rule_ord: Column,
    description: Column,
    severity: Column,
    techniques: Column,
    tactics: Column,
    score: Column | None = None,
) -> DataFrame:
    """Give rolled-up alerts their rule's metadata; output has ALERT_COLUMNS."""
    return rolled.withColumns({
        "rule_name": rule_name,
        "rule_source": F.lit(rule_source),
        "src_rank": F.lit(SOURCE_RANK[rule_source]),
        "rule_ord": rule_ord.cast("int"),
        "description": description,
        "severity": severity,
        "weight": severity_weight(severity),
        "techniques": techniques,
        "tactics": tactics,
        "score": (F.lit(1.0) if score is None else score).cast("double"),
        "status": F.lit("new"),
        "ts": F.timestamp_micros("us"),
        "alert_id": alert_id(),
    }).select(*ALERT_COLUMNS)


def dedup(alerts: DataFrame, parity: bool = False) -> DataFrame:
    """one alert per rule, first host, key and minute; the earliest wins.

    parity=True leaves the key out, so two keys on one host in the same minute collapse to one alert.
    """
    keys = ["rule_id", "first_host", F.date_trunc("minute", "ts")]
    if not parity:
        keys.append("key_value")
    return first_rows(alerts, keys, ["us", "seq_hi", "key_value", "mark"])


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def sorted_alerts(alerts: DataFrame, limit: int | None = None) -> DataFrame:
    """most severe first, then in the order they were raised."""
    ordered = alerts.orderBy(F.col("weight").desc(), "src_rank", "rule_ord", "us", "seq_hi", "key_value", "mark")
    return ordered if limit is None else ordered.limit(limit)


def alert_projection(alerts: DataFrame) -> DataFrame:
    """The alert columns a result listing shows."""
    return alerts.select(
        "alert_id", "rule_name", "rule_source", "description", "severity", "ts",
        F.col("n_events").alias("event_count"), "techniques", "tactics", "status",
    )


def _kinds() -> Column:
    return F.explode(F.array(
        F.struct(F.lit("host").alias("kind"), F.col("hostname").alias("value")),
        F.struct(F.lit("user").alias("kind"), F.col("username").alias("value")),
        F.struct(F.lit("ip").alias("kind"), F.col("source_ip").alias("value")),
    )).alias("__ind")


def _first_of(tagged: DataFrame, keys: list[str], owner: Column, name: str) -> DataFrame:
    return (
        tagged.groupBy(*keys, "hostname", "username", "source_ip")
        .agg(F.min(F.struct("us", "seq")).alias("__first"))
        .select(owner.alias(name), "__first", _kinds())
        .select(name, "__ind.kind", "__ind.value", "__first")
        .filter("value <> ''")
        .groupBy(name, "kind", "value")
        .agg(F.min("__first").alias("__first"))
        .select(name, "kind", "value",
                F.col("__first.us").alias("first_us"), F.col("__first.seq").alias("first_seq"))
    )


def entities(tagged: DataFrame) -> DataFrame:
    """The hosts, users and addresses in each alert's evidence, with their first occurrence.

    One row per (alert, kind, value): an alert over many users stays many small rows.
    """
    return _first_of(tagged, ALERT_KEY, alert_id(), "alert_id")


def by_kind(rows: DataFrame, *columns: str) -> DataFrame:
    """The host, user and address of each row, as rows of their own with the given columns."""
    return rows.select(*columns, _kinds()).select(*columns, "__ind.kind", "__ind.value").filter("value <> ''")


def entities_beside(tagged: DataFrame, alerts: DataFrame) -> DataFrame:
    """entities() of the given alerts (alert_id, ...) beside their columns.

    Evidence meets its alerts before it is told by kind, and alerts stay where they met.
    """
    seen = tagged.groupBy(*ALERT_KEY, "hostname", "username", "source_ip").agg(F.min(F.struct("us", "seq")).alias("__first"))
    met = seen.withColumn("alert_id", alert_id()).drop(*ALERT_KEY).join(alerts, "alert_id")
    return earliest(by_kind(met, *alerts.columns, "__first"), alerts.columns)


def earliest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per (columns, kind, value), with the least __first."""
    return rows.groupBy(*columns, "kind", "value").agg(F.min("__first").alias("__first")).select(
        *columns, "kind", "value", F.col("__first.us").alias("first_us"), F.col("__first.seq").alias("first_seq"))


@dataclass(frozen=True)
class Entities:
    """The entities of alerts: listed, or those of blocks of rows where alerts share most of their rows.

    listed has the columns of entities(), uses (alert_id, block), blocks (block, kind, value, first_us, first_seq).
    """

    listed: DataFrame
    uses: DataFrame | None = None
    blocks: DataFrame | None = None

    def of(self, alerts: DataFrame) -> Entities:
        """Those of the given alerts."""
        ids = alerts.select("alert_id")
        uses = None if self.uses is None else self.uses.join(ids, "alert_id", "left_semi")
        return Entities(self.listed.join(ids, "alert_id", "left_semi"), uses, self.blocks)

    def rows(self) -> DataFrame:
        """All of them listed, as entities() does; as many rows as alerts have entities."""
        if self.uses is None:
            return self.listed
        shared = self.uses.join(self.blocks, "block").groupBy("alert_id", "kind", "value").agg(
            F.min(F.struct("first_us", "first_seq")).alias("__first"))
        return self.listed.unionByName(shared.select("alert_id", "kind", "value", "__first.first_us", "__first.first_seq"))


def shared_entities(listed: DataFrame, uses: DataFrame, rows: DataFrame) -> Entities:
    """Entities from listed evidence, from the blocks that alerts use (alert_id, block) and from the rows of blocks; written once."""
    uses = cut_released(uses)
    held = rows.join(uses.select("block").distinct(), "block", "left_semi")
    return Entities(cut_released(entities(listed)), uses, cut_released(_first_of(held, ["block"], F.col("block"), "block")))


def indicators(found: DataFrame) -> DataFrame:
    """the entities that tie alerts together; the host `unknown` does not."""
    return found.filter((F.col("kind") != "host") | (F.col("value") != UNKNOWN_HOST))


def summary(alerts: DataFrame, incidents: DataFrame | None = None) -> DataFrame:
    """totals by severity, and the number of incidents."""
    counts = [F.count("*").alias("total_alerts")]
    counts += [F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "high", "medium", "low", "info")]
    totals = alerts.agg(*counts)
    if incidents is None:
        return totals
    n = incidents.agg(F.count("*").alias("incidents"))
    return totals.join(n, how="cross")  # one row by one row
