"""Threshold detectors D1-D7 and their alerts.

Each detector yields its *evidence*: the event rows of every alert, tagged with rule, key and a mark that tells the
alerts of one key apart. Alerts and indicators are aggregates of the evidence.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.predicates import failed_auth, filled, holds, is_failed_auth, success_auth
from ..functions.severity import title_case
from ..schema import UNKNOWN_HOST, with_micros
from ..session import cut_released, cut_union
from . import alerts as al
from .alerts import EVIDENCE_EVENT_COLUMNS, complete, evidence, roll_up, roll_up_ranges, union_all
from .ordered import (
    CHUNK_ROWS, SECOND, by_blocks, distinct_picks, first_diverse_anchor, first_rows, firsts_in_spans, next_mark, rows_in_ranges, rows_in_spans, running_count,
    shifted, spaced_picks,
)

MINUTE_US = 60 * SECOND


@dataclass(frozen=True)
class ThresholdConfig:
    """Detector parameters; the defaults are the reference values."""

    window: timedelta = timedelta(minutes=5)
    failures: int = 10
    enum_users: int = 5
    lateral_hosts: int = 4
    process_burst: int = 30
    priv_esc: int = 5
    work_hours: tuple[int, int] = (6, 22)
    chunk_rows: int = CHUNK_ROWS

    @property
    def window_us(self) -> int:
        return self.window // timedelta(microseconds=1)


@dataclass(frozen=True)
class Detector:
    name: str
    about: str
    severity: str
    key_kind: str
    techniques: list[str]
    tactics: list[str]
    find: Callable[[DataFrame, ThresholdConfig], DataFrame] = field(repr=False)
    detail: Callable[[ThresholdConfig], Column] = field(repr=False)
    extra: Callable[[], list[Column]] = field(default=list, repr=False)
    key: str = ""
    ranges: Callable[[DataFrame, ThresholdConfig], Ranges] | None = field(default=None, repr=False)


@dataclass(frozen=True)
class Ranges:
    """Alerts that each hold a run of consecutive rows of their key, many of them the same rows.

    rows are ranked per key, spans name the first and last rank of every alert (key, mark, first, last).
    """

    rows: DataFrame
    spans: DataFrame


def _rows(events: DataFrame, condition: Column, *more: str) -> DataFrame:
    return with_micros(events.filter(condition)).select(*EVIDENCE_EVENT_COLUMNS, *more)


def _anchors(rows: DataFrame, key: str, n: int, cfg: ThresholdConfig) -> DataFrame:
    """Rows that open a window of n rows of the same key (W1): the (n-1)-th row after lies inside the window."""
    ranked = running_count(rows, [key], "rank")
    ahead = shifted(ranked, [key], "us", n - 1, "__nth_us", chunk_rows=cfg.chunk_rows)
    return ahead.filter(F.col("__nth_us") - F.col("us") <= cfg.window_us)


def _spans(anchors: DataFrame, key: str, cfg: ThresholdConfig) -> DataFrame:
    return anchors.select(
        key, F.col("us").alias("lo_us"), F.col("seq").alias("lo_seq"),
        (F.col("us") + cfg.window_us).alias("hi_us"), F.col("seq").alias("mark"))


def _span_evidence(rule: str, kind: str, key: str, anchors: DataFrame, rows: DataFrame, cfg: ThresholdConfig) -> DataFrame:
    inside = rows_in_spans(_spans(anchors, key, cfg), rows, [key], cfg.window_us)
    return evidence(inside, rule, kind, F.col(key), F.col("mark"))


def brute_force_ranges(events: DataFrame, cfg: ThresholdConfig) -> Ranges:
    """Windows of failures from one address; the first of each start minute counts.

    A window may open in every minute, so windows overlap as far as they are long. They stay ranges of ranks: a running
    count gives the last rank of each. Rows without a seq have no place beside rows of the same time, so a window that
    such a row opens begins behind that time.
    """
    key = "source_ip"
    rows = _rows(events, failed_auth() & filled(F.col(key)))
    ranked = running_count(rows, [key], "rank", order=("us", "seq", "hostname"))
    ahead = shifted(ranked, [key], "us", cfg.failures - 1, "__nth_us", chunk_rows=cfg.chunk_rows)
    opened = first_rows(
        ahead.filter(F.col("__nth_us") - F.col("us") <= cfg.window_us), [key, F.expr(f"us div {MINUTE_US}")], ["us", "seq", "rank"])
    anchors = cut_released(opened.select(key, "us", F.col("seq").alias("mark"), F.col("rank").alias("first")))
    probes = anchors.select(key, (F.col("us") + cfg.window_us).alias("us"), "mark", "first", F.lit(1).alias("__probe")).unionByName(
        anchors.filter("mark IS NULL").select(key, "us", "mark", "first", F.lit(2).alias("__probe")))
    counted = running_count(
        ranked.select(key, "us", F.lit(0).alias("__probe")).unionByName(probes, allowMissingColumns=True),
        [key], "last", order=("us", "__probe", "first"), flag=F.col("__probe") == 0)
    behind = counted.filter("__probe = 2").select(key, "first", F.col("last").alias("__behind"))
    spans = (
        counted.filter("__probe = 1").join(behind, [key, "first"], "left")
        .withColumn("first", F.coalesce(F.col("__behind") + 1, "first"))
        .filter("first <= last").select(key, "mark", "first", "last"))
    return Ranges(ranked, cut_released(spans))


def range_evidence(rule: str, found: Ranges, first: int | None = None) -> DataFrame:
    """The rows of every alert that is a range, or only its first ones."""
    d = DETECTORS[rule]
    return evidence(rows_in_ranges(found.spans, found.rows, d.key, first), rule, d.key_kind, F.col(d.key), F.col("mark"))


def brute_force(events: DataFrame, cfg: ThresholdConfig) -> DataFrame:
    """The rows of all windows, repeated where windows overlap."""
    return range_evidence("threshold_brute_force_ip", brute_force_ranges(events, cfg))


def account_enum(events: DataFrame, cfg: ThresholdConfig) -> DataFrame:
    """Failures from one address up to the n-th distinct user, then from the start again; no time limit."""
    rows = _rows(events, failed_auth() & filled(F.col("source_ip")) & filled(F.col("username")))
    ranked = running_count(rows, ["source_ip"], "rank")
    fired = distinct_picks(ranked, ["source_ip"], "username", cfg.enum_users, cfg.chunk_rows)
    used = next_mark(ranked, fired, ["source_ip"], cfg.chunk_rows)
    return evidence(used, "threshold_account_enum", "ip", F.col("source_ip"), F.col("mark"))


def credential_stuffing(events: DataFrame, cfg: ThresholdConfig) -> DataFrame:
    """D3: a success after n failures within the window that ends at the latest failure; firing clears the failures.

    With failures counted per address, a success can fire if the n-th failure before it lies in the window; among
    those, firing needs n new failures since the last firing, a spaced choice over the failure count.
    """
    n = cfg.failures
    key = ["source_ip"]
    rows = _rows(
        events.withColumn("__failed", is_failed_auth()),
        filled(F.col("source_ip")) & (F.col("category") == "authentication") & (failed_auth() | success_auth()), "__failed")
    counted = running_count(rows, key, "rank", flag=F.col("__failed"))
    failures = counted.filter("__failed").drop("__failed")
    successes = (
        counted.filter(~F.col("__failed") & (F.col("rank") >= n))
        .groupBy(*key, "rank").agg(F.min(F.struct("us", "seq", "hostname", "username", "category", "command_line")).alias("hit"))
    )
    dense = (
        shifted(failures, key, "us", 1 - n, "__nth_us", chunk_rows=cfg.chunk_rows)
        .filter(F.col("us") - F.col("__nth_us") <= cfg.window_us)
    )
    candidates = cut_released(dense.select(*key, "rank", "us").join(successes, [*key, "rank"]))
    fired = candidates.join(spaced_picks(candidates, key, n, cfg.chunk_rows), [*key, "rank"])
    held = (
        next_mark(failures, fired.select(*key, "rank"), key, cfg.chunk_rows)
        .join(fired.select(*key, F.col("rank").alias("mark"), F.col("us").alias("__last_us")), [*key, "mark"])
        .filter(F.col("us") >= F.col("__last_us") - cfg.window_us)
        .select(*key, "mark", "seq", "us", "hostname", "username", "category", "command_line")
    )
    trigger = fired.select(
        *key, F.col("rank").alias("mark"), "hit.seq", "hit.us", "hit.hostname", "hit.username", "hit.category", "hit.command_line")
    return evidence(
        held.unionByName(trigger), "threshold_credential_stuffing", "ip", F.col("source_ip"), F.col("mark"))


def lateral_movement(events: DataFrame, cfg: ThresholdConfig) -> DataFrame:
    """The first window in which one user logs on to n distinct hosts."""
    rows = _rows(events, success_auth() & filled(F.col("username")) & (F.col("hostname") != UNKNOWN_HOST))
    ranked = running_count(rows, ["username"], "rank")
    first = first_diverse_anchor(
        ranked, ["username"], "hostname", cfg.lateral_hosts, cfg.window_us, cfg.chunk_rows)
    anchors = ranked.join(first, ["username", "rank"])
    return _span_evidence("threshold_lateral_movement", "user", "username", anchors, rows, cfg)


def after_hours(events: DataFrame, cfg: ThresholdConfig) -> DataFrame:
    """A success outside working hours."""
    start, end = cfg.work_hours
    hour = F.hour("ts")
    rows = _rows(events, success_auth() & ~((hour >= start) & (hour < end)))
    return evidence(rows, "threshold_after_hours_login", "host", F.col("hostname"), F.col("seq"))


def process_burst(events: DataFrame, cfg: ThresholdConfig) -> DataFrame:
    """The first window with n process starts on one host."""
    rows = _rows(events, F.col("category") == "process")
    first = first_rows(_anchors(rows, "hostname", cfg.process_burst, cfg), ["hostname"], ["us", "seq"])
    return _span_evidence("threshold_process_burst", "host", "hostname", first, rows, cfg)


def privilege_use() -> Column:
    by_tag = holds(F.arrays_overlap("tags", F.array(F.lit("sudo"), F.lit("su"))))
    return by_tag | holds(F.col("event_id").isin(4672, 4673, 4674))


def priv_esc(events: DataFrame, cfg: ThresholdConfig) -> DataFrame:
    """The first window with n privilege events of one user."""
    rows = _rows(events, privilege_use() & filled(F.col("username")))
    first = first_rows(_anchors(rows, "username", cfg.priv_esc, cfg), ["username"], ["us", "seq"])
    return _span_evidence("threshold_repeated_privilege_escalation", "user", "username", first, rows, cfg)


def _text(template: str, *cols: Column) -> Column:
    return F.format_string(template, *cols)


# Rule names, severities, technique ids and detail formats of the built-in detectors, in firing order.
DETECTORS: dict[str, Detector] = {
    "threshold_brute_force_ip": Detector(
        "Brute Force from Single IP", "Many failed logins from one address within the window.", "high", "ip",
        ["T1110.001"], ["credential-access"], brute_force,
        lambda cfg: _text(f"IP=%s, count=%s in {cfg.window}", F.col("key_value"), F.col("n_events")),
        key="source_ip", ranges=brute_force_ranges),
    "threshold_account_enum": Detector(
        "Account Enumeration", "Failed logins of many different users from one address.", "high", "ip",
        ["T1087.001"], ["discovery"], account_enum,
        lambda cfg: _text(f"IP=%s, distinct_users={cfg.enum_users}", F.col("key_value"))),
    "threshold_credential_stuffing": Detector(
        "Credential Stuffing — Success After Failures", "A login worked after many failures from the same address.",
        "critical", "ip", ["T1110.004"], ["credential-access", "initial-access"], credential_stuffing,
        lambda cfg: _text("IP=%s, failures=%s, then success user=%s", F.col("key_value"), F.col("n_events") - 1,
                          F.coalesce(F.col("__last_user"), F.lit("None"))),
        lambda: [F.max_by("username", F.struct("us", "seq")).alias("__last_user")]),
    "threshold_lateral_movement": Detector(
        "Lateral Movement — Multi-Host Auth", "One user logged on to many hosts within the window.", "high", "user",
        ["T1021.001", "T1021.002"], ["lateral-movement"], lateral_movement,
        lambda cfg: _text("user=%s, hosts=['%s']", F.col("key_value"),
                          F.array_join(F.array_sort("__hosts"), "', '")),
        lambda: [F.collect_set("hostname").alias("__hosts")]),
    "threshold_after_hours_login": Detector(
        "After-Hours Authentication Success", "A login worked outside working hours.", "medium", "host",
        ["T1078"], ["defense-evasion", "persistence"], after_hours,
        lambda cfg: _text("user=%s, hour=%s:00 UTC", F.coalesce(F.col("__user"), F.lit("None")),
                          F.date_format(F.timestamp_micros("us"), "HH")),
        lambda: [F.max("username").alias("__user")]),
    "threshold_process_burst": Detector(
        "Process Spawning Burst", "Many processes started on one host within the window.", "medium", "host",
        ["T1059"], ["execution"], process_burst,
        lambda cfg: _text(f"host=%s, count=%s in {cfg.window}", F.col("key_value"), F.col("n_events"))),
    "threshold_repeated_privilege_escalation": Detector(
        "Repeated Privilege Escalation Attempts", "One user used sudo, su or special privileges again and again.",
        "high", "user", ["T1548.003"], ["privilege-escalation"], priv_esc,
        lambda cfg: _text(f"user=%s, count=%s in {cfg.window}", F.col("key_value"), F.col("n_events"))),
}


def to_alerts(rule_id: str, found: DataFrame, cfg: ThresholdConfig) -> DataFrame:
    """The alerts of one detector from its evidence."""
    return _complete(rule_id, roll_up(found, *DETECTORS[rule_id].extra()), cfg)


def range_alerts(rule_id: str, found: Ranges, cfg: ThresholdConfig) -> DataFrame:
    """The alerts of a detector that finds ranges, without their evidence."""
    d = DETECTORS[rule_id]
    return _complete(rule_id, roll_up_ranges(found.spans, found.rows, rule_id, d.key_kind, d.key), cfg)


def _complete(rule_id: str, rolled: DataFrame, cfg: ThresholdConfig) -> DataFrame:
    d = DETECTORS[rule_id]
    return complete(
        rolled,
        rule_name=F.lit(d.name),
        rule_source="threshold",
        rule_ord=F.lit(list(DETECTORS).index(rule_id)),
        description=F.concat_ws(" ", F.lit(d.about), d.detail(cfg)),
        severity=F.lit(d.severity),
        techniques=F.array(*map(F.lit, d.techniques)),
        tactics=F.transform(F.array(*map(F.lit, d.tactics)), title_case),
    )


@dataclass(frozen=True)
class Found:
    """What detectors found: written evidence of those that list it, ranges of those whose alerts overlap."""

    configs: dict[str, ThresholdConfig]
    listed: DataFrame | None
    ranges: dict[str, Ranges]

    def alert_parts(self) -> list[DataFrame]:
        """The alerts of each rule."""
        return [
            range_alerts(rule, self.ranges[rule], cfg) if rule in self.ranges
            else to_alerts(rule, self.listed.filter(F.col("rule_id") == rule), cfg) for rule, cfg in self.configs.items()]

    def alerts(self) -> DataFrame:
        return union_all(self.alert_parts())

    def evidence(self, first: int | None = None) -> DataFrame:
        """All evidence rows, or at least the `first` ones of every alert (then overlaps cost no more than that)."""
        parts = [] if self.listed is None else [self.listed]
        return union_all([*parts, *(range_evidence(rule, found, first) for rule, found in self.ranges.items())])

    def of(self, alerts: DataFrame) -> Found:
        """What the given alerts were made from; ranges are chosen before their rows are listed."""
        ids = alerts.select("alert_id")

        def chosen(rows: DataFrame) -> DataFrame:
            return rows.withColumn("alert_id", al.alert_id()).join(ids, "alert_id", "left_semi").drop("alert_id")

        def kept(rule: str, found: Ranges) -> Ranges:
            named = found.spans.withColumns({"rule_id": F.lit(rule), "key_value": F.col(DETECTORS[rule].key)})
            return replace(found, spans=chosen(named).select(found.spans.columns))

        return replace(self, listed=None if self.listed is None else chosen(self.listed), ranges={rule: kept(rule, found) for rule, found in self.ranges.items()})

    def blocks(self) -> tuple[DataFrame, DataFrame]:
        """(alert_id, block) of the alerts that are ranges, and the rows of the blocks."""
        uses, rows = [], []
        for rule, found in self.ranges.items():
            key = DETECTORS[rule].key
            block = F.concat_ws("~", F.lit(rule), "__part.level", "__part.block", key).alias("block")
            parts, held = by_blocks(found.spans, found.rows, key)
            uses.append(
                parts.withColumns({"rule_id": F.lit(rule), "key_value": F.col(key)}).select(al.alert_id().alias("alert_id"), block))
            rows.append(held.select(block, *EVIDENCE_EVENT_COLUMNS))
        return union_all(uses), union_all(rows)

    def entities(self) -> al.Entities:
        """The entities of all alerts; alerts that overlap share theirs."""
        return al.shared_entities(self.listed, *self.blocks()) if self.ranges else al.Entities(cut_released(al.entities(self.listed)))

    def entities_beside(self, alerts: DataFrame) -> DataFrame:
        """The given alerts (alert_id, ...) beside each of their entities, as entities().of(alerts).rows() lists them.

        Entities of ranges come out of the join that finds them; only alerts of several ranges are summed up.
        """
        parts = [] if self.listed is None else [al.entities_beside(self.listed, alerts)]
        for rule, found in self.ranges.items():
            key = DETECTORS[rule].key
            named = found.spans.withColumns({"rule_id": F.lit(rule), "key_value": F.col(key)})
            spans = named.select(key, "first", "last", al.alert_id().alias("alert_id")).join(alerts, "alert_id")
            spans = cut_released(spans.withColumn("__ranges", F.count("*").over(Window.partitionBy("alert_id"))))
            values = al.by_kind(found.rows.withColumn("__key", F.col(key)), "__key", "rank", "us", "seq").withColumnRenamed("__key", key)
            met = firsts_in_spans(spans, values, key).withColumn("__first", F.struct("us", "seq"))
            once = met.filter("__ranges = 1").select(
                *alerts.columns, "kind", "value", F.col("us").alias("first_us"), F.col("seq").alias("first_seq"))
            parts += [once, al.earliest(met.filter("__ranges > 1"), alerts.columns)]
        return union_all(parts)

    def timeline(self, members: DataFrame) -> DataFrame:
        """F10 with repeats counted: the evidence rows of every incident, and how many of its alerts hold each (times).

        Rows of shared blocks come once per incident and block, whatever the number of alerts.
        """
        columns = ["incident", *EVIDENCE_EVENT_COLUMNS, "times"]
        rows = self.listed.withColumn("alert_id", al.alert_id()).join(members, "alert_id").withColumn("times", F.lit(1).cast("long")).select(columns)
        if not self.ranges:
            return rows
        uses, held = self.blocks()
        met = members.join(uses, "alert_id").groupBy("incident", "block").agg(F.count("*").alias("times"))
        return rows.unionByName(held.join(met, "block").select(columns))


def find(events: DataFrame, configs: dict[str, ThresholdConfig]) -> Found:
    """What the named detectors find, each with its parameters; written once, as alerts and entities both use it."""
    listing = [DETECTORS[rule].find(events, cfg) for rule, cfg in configs.items() if not DETECTORS[rule].ranges]
    return Found(
        configs, cut_union(listing, "rule_id") if listing else None,
        {rule: DETECTORS[rule].ranges(events, cfg) for rule, cfg in configs.items() if DETECTORS[rule].ranges})


def detect(events: DataFrame, cfg: ThresholdConfig = ThresholdConfig()) -> Found:
    """All detectors."""
    return find(events, dict.fromkeys(DETECTORS, cfg))


def detect_one(events: DataFrame, rule: str, cfg: ThresholdConfig = ThresholdConfig()) -> DataFrame:
    """Alerts of a single detector, with nothing written for its evidence."""
    d = DETECTORS[rule]
    return range_alerts(rule, d.ranges(events, cfg), cfg) if d.ranges else to_alerts(rule, d.find(events, cfg), cfg)


def brute_force_unbounded(events: DataFrame, cfg: ThresholdConfig = ThresholdConfig()) -> DataFrame:
    """D1 as the reference computes it: a window that starts at the anchor and never ends (parity).

    The count from an anchor to the end is the address's total minus the rows before it.
    """
    rows = _rows(events, failed_auth() & filled(F.col("source_ip")))
    totals = rows.groupBy("source_ip").agg(F.count("*").alias("__total"), F.max("us").alias("last_us"))
    counted = (
        running_count(rows, ["source_ip"], "rank").join(totals, "source_ip")
        .withColumn("n_events", F.col("__total") - F.col("rank") + 1)
        .filter(F.col("n_events") >= cfg.failures)
    )
    first = first_rows(counted, ["source_ip", F.expr(f"us div {MINUTE_US}")], ["us", "seq"])
    return first.select(
        "source_ip", F.col("us").alias("anchor_us"), F.col("seq").alias("anchor_seq"), "n_events", "last_us")
