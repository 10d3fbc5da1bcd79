"""Queries over the threshold detectors (D*, W*)."""

from __future__ import annotations

from dataclasses import replace
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import thresholds as th
from ..operators.ordered import session_summary
from ..schema import with_micros
from .fixture import DAY_US, events, with_ev
from .registry import query

# The test table holds a few events per key and day, so windows are days long.
CFG = th.ThresholdConfig()
FAILURES = replace(CFG, window=timedelta(days=2), failures=10)
STUFFING = replace(CFG, window=timedelta(days=3), failures=10)
LATERAL = replace(CFG, window=timedelta(days=7), lateral_hosts=5)
BURST = replace(CFG, window=timedelta(days=2), process_burst=20)
PRIV = replace(CFG, window=timedelta(days=7), priv_esc=5)


def plain(alerts: DataFrame) -> DataFrame:
    """Alert columns in a form every SQL engine compares alike."""
    return alerts.select(
        "rule_id", "key_value", "severity", F.col("ts").cast("timestamp_ntz").alias("ts"), "seq_lo", "seq_hi",
        "n_events", "first_host", "description")


def run(rule: str, spark, sf_dir, cfg: th.ThresholdConfig) -> DataFrame:
    return plain(th.detect_one(events(spark, sf_dir), rule, cfg))


FAILED = "(category = 'authentication' AND status = 'failure' OR event_id = 4625)"
SUCCESS = "(category = 'authentication' AND status = 'success' OR event_id = 4624)"


def plain_sql(rule: str, source: str, key: str, detail: str, where: str = "") -> str:
    """The SQL form of plain(): source has key, us, lo, hi, n, first_host and what detail uses."""
    d = th.DETECTORS[rule]
    return f"""SELECT '{rule}' AS rule_id, {key} AS key_value, '{d.severity}' AS severity, make_timestamp(us) AS ts,
  lo AS seq_lo, hi AS seq_hi, n AS n_events, first_host, '{d.about} ' || {detail} AS description FROM {source} {where}"""


def window_sql(name: str, key: str, condition: str, width_days: int, n: int, per: str, value: str = "count(*)") -> str:
    """CTEs for an anchored window detector: the first qualifying anchor per `per`."""
    w = f"(PARTITION BY {key} ORDER BY us RANGE BETWEEN CURRENT ROW AND {width_days * DAY_US} FOLLOWING)"
    return f"""
{name}_w AS (
  SELECT *, count(*) OVER w AS n, last_value(us) OVER w AS last_us, last_value(seq) OVER w AS hi,
         list_sort(list_distinct(list(hostname) OVER w)) AS hosts
  FROM ev WHERE {condition} WINDOW w AS {w}),
{name} AS (
  SELECT {key}, us AS lo_us, last_us AS us, seq AS lo, hi, n, hostname AS first_host, hosts, row_number() OVER (PARTITION BY {per} ORDER BY us, seq) AS rn
  FROM {name}_w WHERE {value} >= {n} QUALIFY rn = 1)"""


D1_SQL = window_sql("d1", "source_ip", FAILED, 2, 10, "source_ip, us // 60000000", "n")
D1_OUT = plain_sql("threshold_brute_force_ip", "d1", "source_ip",
                   "'IP=' || source_ip || ', count=' || n || ' in 2 days, 0:00:00'")
D4_SQL = window_sql("d4", "username", f"{SUCCESS} AND hostname <> 'unknown'", 7, 5, "username", "len(hosts)")
D4_OUT = plain_sql("threshold_lateral_movement", "d4", "username",
                   "'user=' || username || ', hosts=[''' || array_to_string(hosts, ''', ''') || ''']'")
D6_SQL = window_sql("d6", "hostname", "category = 'process'", 2, 20, "hostname", "n")
D6_OUT = plain_sql("threshold_process_burst", "d6", "hostname",
                   "'host=' || hostname || ', count=' || n || ' in 2 days, 0:00:00'")
D7_SQL = window_sql("d7", "username", "(list_has_any(tags, ['sudo', 'su']) OR event_id IN (4672, 4673, 4674))",
                    7, 5, "username", "n")
D7_OUT = plain_sql("threshold_repeated_privilege_escalation", "d7", "username",
                   "'user=' || username || ', count=' || n || ' in 7 days, 0:00:00'")
D5_SQL = f"""
d5 AS (SELECT hostname, username, us, seq AS lo, seq AS hi, 1 AS n, hostname AS first_host, hour(ts) AS h
       FROM ev WHERE {SUCCESS} AND NOT (hour(ts) >= 6 AND hour(ts) < 22))"""
D5_OUT = plain_sql("threshold_after_hours_login", "d5", "hostname",
                   "'user=' || username || ', hour=' || lpad(CAST(h AS VARCHAR), 2, '0') || ':00 UTC'")

# Order-dependent detectors: one recursion step per row of each key.
D2_SQL = f"""
d2_in AS (SELECT source_ip, username, us, seq, hostname,
    row_number() OVER (PARTITION BY source_ip ORDER BY us, seq) AS rn FROM ev WHERE {FAILED}),
d2_walk AS (
  SELECT source_ip, rn, us, seq, [username] AS users, seq AS lo, us AS lo_us, hostname AS first_host, 1 AS n, false AS fire
  FROM d2_in WHERE rn = 1
  UNION ALL
  SELECT w.source_ip, i.rn, i.us, i.seq,
    CASE WHEN w.fire THEN [i.username] ELSE list_distinct(list_append(w.users, i.username)) END,
    CASE WHEN w.fire THEN i.seq ELSE w.lo END,
    CASE WHEN w.fire THEN i.us ELSE w.lo_us END,
    CASE WHEN w.fire THEN i.hostname ELSE w.first_host END,
    CASE WHEN w.fire THEN 1 ELSE w.n + 1 END,
    NOT w.fire AND len(list_distinct(list_append(w.users, i.username))) >= 5
  FROM d2_walk w JOIN d2_in i ON i.source_ip = w.source_ip AND i.rn = w.rn + 1),
d2 AS (SELECT source_ip, us, lo_us, lo, seq AS hi, n, first_host FROM d2_walk WHERE fire)"""
D2_OUT = plain_sql("threshold_account_enum", "d2", "source_ip", "'IP=' || source_ip || ', distinct_users=5'")

D3_SQL = f"""
d3_in AS (SELECT source_ip, username, us, seq, hostname, {FAILED} AS failed,
    row_number() OVER (PARTITION BY source_ip ORDER BY us, seq) AS rn
  FROM ev WHERE category = 'authentication' AND ({FAILED} OR {SUCCESS})),
d3_walk AS (
  SELECT source_ip, rn, us, seq, username,
    CASE WHEN failed THEN [{{'us': us, 'seq': seq, 'host': hostname}}] ELSE [] END AS held, failed, false AS fire
  FROM d3_in WHERE rn = 1
  UNION ALL
  SELECT i.source_ip, i.rn, i.us, i.seq, i.username,
    CASE WHEN i.failed THEN list_append(
           CASE WHEN w.fire THEN [] ELSE list_filter(w.held, lambda x: x.us >= i.us - {3 * DAY_US}) END,
           {{'us': i.us, 'seq': i.seq, 'host': i.hostname}})
         WHEN w.fire THEN [] ELSE w.held END,
    i.failed,
    NOT i.failed AND NOT w.fire AND len(w.held) >= 10
  FROM d3_walk w JOIN d3_in i ON i.source_ip = w.source_ip AND i.rn = w.rn + 1),
d3 AS (SELECT source_ip, username, us, held[1].seq AS lo, seq AS hi, len(held) + 1 AS n, held[1].host AS first_host, held
       FROM d3_walk WHERE fire)"""
D3_OUT = plain_sql("threshold_credential_stuffing", "d3", "source_ip",
                   "'IP=' || source_ip || ', failures=' || (n - 1) || ', then success user=' || username")


@query("brute_force", with_ev(D1_SQL, select=D1_OUT))
def brute_force(spark, sf_dir):
    """Windows of failures per address, the first of each minute."""
    return run("threshold_brute_force_ip", spark, sf_dir, FAILURES)


@query("brute_force_unbounded", with_ev(f"""
w AS (SELECT source_ip, us, seq, count(*) OVER f AS n_events, max(us) OVER f AS last_us
      FROM ev WHERE {FAILED}
      WINDOW f AS (PARTITION BY source_ip ORDER BY us, seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""",
    select="""SELECT source_ip, us AS anchor_us, seq AS anchor_seq, n_events, last_us FROM w WHERE n_events >= 10
QUALIFY row_number() OVER (PARTITION BY source_ip, us // 60000000 ORDER BY us, seq) = 1"""))
def brute_force_unbounded(spark, sf_dir):
    """D1 with the never-ending window of the reference."""
    return th.brute_force_unbounded(events(spark, sf_dir), CFG)


@query("account_enum", with_ev(D2_SQL, select=D2_OUT))
def account_enum(spark, sf_dir):
    """Every fifth distinct user per address."""
    return run("threshold_account_enum", spark, sf_dir, CFG)


@query("credential_stuffing", with_ev(D3_SQL, select=D3_OUT))
def credential_stuffing(spark, sf_dir):
    """A success after ten failures."""
    return run("threshold_credential_stuffing", spark, sf_dir, STUFFING)


@query("lateral_movement", with_ev(D4_SQL, select=D4_OUT))
def lateral_movement(spark, sf_dir):
    """One user on many hosts."""
    return run("threshold_lateral_movement", spark, sf_dir, LATERAL)


@query("after_hours", with_ev(D5_SQL, select=D5_OUT))
def after_hours(spark, sf_dir):
    """Successes outside working hours."""
    return run("threshold_after_hours_login", spark, sf_dir, CFG)


@query("process_burst", with_ev(D6_SQL, select=D6_OUT))
def process_burst(spark, sf_dir):
    """Many processes on one host."""
    return run("threshold_process_burst", spark, sf_dir, BURST)


@query("priv_esc", with_ev(D7_SQL, select=D7_OUT))
def priv_esc(spark, sf_dir):
    """Many privilege events of one user."""
    return run("threshold_repeated_privilege_escalation", spark, sf_dir, PRIV)


RUNS = {
    "threshold_brute_force_ip": FAILURES, "threshold_account_enum": CFG, "threshold_credential_stuffing": STUFFING,
    "threshold_lateral_movement": LATERAL, "threshold_after_hours_login": CFG, "threshold_process_burst": BURST,
    "threshold_repeated_privilege_escalation": PRIV,
}
ALL_SQL = [D1_SQL, D2_SQL, D3_SQL, D4_SQL, D5_SQL, D6_SQL, D7_SQL]
ALL_OUT = "\nUNION ALL\n".join([D1_OUT, D2_OUT, D3_OUT, D4_OUT, D5_OUT, D6_OUT, D7_OUT])


def detect_all(ev: DataFrame) -> th.Found:
    """All detectors, each with the window that suits the test table."""
    return th.find(ev, RUNS)


@query("threshold_union", with_ev(*ALL_SQL, select=ALL_OUT))
def threshold_union(spark, sf_dir):
    """The alerts of all seven detectors."""
    return plain(detect_all(events(spark, sf_dir)).alerts())


@query("activity_sessions", with_ev("""
g AS (SELECT hostname, us, CASE WHEN us - lag(us) OVER (PARTITION BY hostname ORDER BY us) <= 1800000000 THEN 0 ELSE 1 END AS opens FROM ev),
s AS (SELECT hostname, us, sum(opens) OVER (PARTITION BY hostname ORDER BY us) AS session FROM g)""",
    select="""SELECT hostname, make_timestamp(min(us)) AS first_seen, make_timestamp(max(us)) AS last_seen, count(*) AS n_events
FROM s GROUP BY hostname, session"""))
def activity_sessions(spark, sf_dir):
    """Bursts of activity per host, split at gaps of more than 30 minutes."""
    return session_summary(with_micros(events(spark, sf_dir)), ["hostname"], 30 * th.MINUTE_US).select(
        "hostname", F.timestamp_micros("first_us").cast("timestamp_ntz").alias("first_seen"),
        F.timestamp_micros("last_us").cast("timestamp_ntz").alias("last_seen"), "n_events")
