"""Queries over predicates and declarative rules (B*, C*, R*)."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions.predicates import event_projection, is_failed_auth, is_success_auth
from ..functions.severity import attack_tactics, attack_techniques, level_to_severity, severity_weight
from ..operators import rules as ru
from ..operators.rule_index import match_indexed
from .detectors import FAILED, SUCCESS
from .fixture import DAY_US, events, table, with_ev
from .registry import query


@query("auth_flags", with_ev(select=f"""
SELECT seq, hostname, category, username, source_ip, status, substr(message, 1, 300) AS message,
  coalesce({FAILED}, false) AS failed, coalesce({SUCCESS}, false) AS succeeded FROM ev"""))
def auth_flags(spark, sf_dir):
    """Login outcome flags beside the listed event columns."""
    flags = [is_failed_auth().alias("failed"), is_success_auth().alias("succeeded")]
    return event_projection(events(spark, sf_dir), "seq", *flags).select(
        "seq", "hostname", "category", "username", "source_ip", "status", "message", "failed", "succeeded")


LEVELS = ["critical", "HIGH", "medium", "low", "informational", "info", "other"]


@query("severity_lookup", f"""
WITH l AS (SELECT event_id, CASE WHEN user_id % 11 = 0 THEN NULL ELSE
  {LEVELS!r}[CAST(props->>'$.k' AS INTEGER) % {len(LEVELS)} + 1] END AS level FROM events),
s AS (SELECT level, CASE lower(level) WHEN 'critical' THEN 'critical' WHEN 'high' THEN 'high' WHEN 'low' THEN 'low'
  WHEN 'informational' THEN 'info' ELSE 'medium' END AS severity FROM l)
SELECT level, severity, CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3
  WHEN 'low' THEN 2 ELSE 1 END AS weight, count(*) AS n FROM s GROUP BY ALL""")
def severity_lookup(spark, sf_dir):
    """Severity and weight of rule levels, over level texts derived from the events."""
    k = F.get_json_object("props", "$.k").cast("int")
    level = F.when(F.col("user_id") % 11 != 0, F.element_at(F.array(*map(F.lit, LEVELS)), k % len(LEVELS) + 1))
    severity = level_to_severity(F.col("level"))
    return (
        table(spark, sf_dir, "events").select(level.alias("level"))
        .withColumn("severity", severity).withColumn("weight", severity_weight(F.col("severity")))
        .groupBy("level", "severity", "weight").agg(F.count("*").alias("n")))


@query("attack_tags", """
WITH t AS (SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k, user_id FROM events),
g AS (SELECT event_id, CASE k % 4 WHEN 0 THEN ['attack.t' || (1000 + k), 'attack.credential_access']
   WHEN 1 THEN ['attack.initial_access', 'attack.t' || (1000 + k) || '.00' || (user_id % 9)]
   WHEN 2 THEN ['cve.2024.' || k, 'attack.command_and_control', 'attack.t1.x'] ELSE [] END AS tags FROM t)
SELECT event_id,
  array_to_string([upper(substr(x, 8)) FOR x IN tags IF starts_with(x, 'attack.t')], ',') AS techniques,
  array_to_string([CASE x WHEN 'attack.credential_access' THEN 'Credential Access' WHEN 'attack.initial_access'
    THEN 'Initial Access' ELSE 'Command And Control' END
    FOR x IN tags IF starts_with(x, 'attack.') AND NOT starts_with(x, 'attack.t')], ',') AS tactics
FROM g""")
def attack_tags(spark, sf_dir):
    """Techniques and tactics out of tag lists derived from the events."""
    k = F.get_json_object("props", "$.k").cast("int")
    number = (F.lit(1000) + k).cast("string")
    tags = (
        F.when(k % 4 == 0, F.array(F.concat(F.lit("attack.t"), number), F.lit("attack.credential_access")))
        .when(k % 4 == 1, F.array(F.lit("attack.initial_access"), F.concat(
            F.lit("attack.t"), number, F.lit(".00"), (F.col("user_id") % 9).cast("string"))))
        .when(k % 4 == 2, F.array(F.concat(F.lit("cve.2024."), k.cast("string")),
                                  F.lit("attack.command_and_control"), F.lit("attack.t1.x")))
        .otherwise(F.array().cast("array<string>")))
    return table(spark, sf_dir, "events").withColumn("tags", tags).select(
        "event_id", F.array_join(attack_techniques(F.col("tags")), ",").alias("techniques"),
        F.array_join(attack_tactics(F.col("tags")), ",").alias("tactics"))


def one_rule(name: str, detection: dict, where: str):
    """Register a query that lists the events one rule matches."""
    rule = ru.parse_rule({"title": name, "detection": detection}, name)

    def build(spark, sf_dir):
        return ru.match_rules(events(spark, sf_dir), [rule]).select("seq", "hostname", "username")

    build.__doc__ = f"Events matching {detection!r}."
    query(name, with_ev(select=f"SELECT seq, hostname, username FROM ev WHERE {where}"))(build)


one_rule("rule_eq", {"selection": {"EventID": 4625, "Computer": "HOST3"}}, "event_id = 4625 AND hostname = 'host3'")
one_rule("rule_in", {"selection": {"EventID": [4624, "4625"], "User": ["user1", "USER2", "user7"]}},
         "event_id IN (4624, 4625) AND username IN ('user1', 'user2', 'user7')")
one_rule("rule_contains", {"selection": {"CommandLine|contains": ["PASSWD", "chmod"]}},
         "command_line LIKE '%passwd%' OR command_line LIKE '%chmod%'")
one_rule("rule_contains_all", {"selection": {"Message|contains|all": ["password", "user1", "10.0.0."]}},
         "message LIKE '%password%' AND message LIKE '%user1%' AND message LIKE '%10.0.0.%'")
one_rule("rule_startswith", {"selection": {"Image|startswith": ["c:\\windows", "/BIN/"]}},
         "lower(process_name) LIKE 'c:\\windows%' OR process_name LIKE '/bin/%'")
one_rule("rule_endswith", {"selection": {"process_name|endswith": ["cmd.exe", "certutil.exe"]}},
         "process_name LIKE '%cmd.exe' OR process_name LIKE '%certutil.exe'")
one_rule("rule_regex", {"selection": {"Message|re": "for user[0-9]*8 FROM 10\\.0"}},
         "regexp_matches(message, 'for user[0-9]*8 from 10\\.0')")
one_rule("rule_array_field", {"selection": {"tags|contains": "SSH_"}, "raw_task": {"TaskName|endswith": "7"},
                              "svc": {"ServiceName": "psexesvc"}, "condition": "selection and raw_task or svc"},
         "(len(list_filter(tags, lambda t: t LIKE '%ssh_%')) > 0 AND task_name LIKE '%7') OR service_name = 'PSEXESVC'")
one_rule("rule_condition_mix", {
    "sel_proc": {"process_name|endswith": "exe"},
    "sel_fail": {"status": "failure", "logon_type": 3},
    "filter_host": {"hostname": ["host1", "unknown"]},
    "filter_null": {"command_line": None},
    "condition": "(1 of sel_* or not sel_fail and not filter_null) and not (filter_host or all of filter_*)"},
    """(coalesce(process_name LIKE '%exe', false) OR coalesce(status = 'failure' AND logon_type = 3, false)
       OR (NOT coalesce(status = 'failure' AND logon_type = 3, false) AND command_line IS NOT NULL))
   AND NOT (hostname IN ('host1', 'unknown') OR (hostname IN ('host1', 'unknown') AND command_line IS NULL))""")

MATCHES = {
    "ssh-brute-force-001": "status = 'failure' AND list_contains(tags, 'ssh_failed')",
    "login-after-failures-001": "status = 'success' AND list_contains(tags, 'ssh_success')",
    "sudo-root-001": "list_contains(tags, 'sudo') AND regexp_matches(lower(command_line), "
                     "'/bin/bash|/bin/sh|/usr/bin/python|chmod|chown|passwd|visudo|crontab')",
    "win-audit-clear-001": "event_id = 1102",
    "win-failed-logon-001": "event_id = 4625",
    "win-schtask-001": "event_id = 4698",
    "win-lolbins-001": "event_id = 4688 AND regexp_matches(lower(process_name), "
                       "'(certutil|mshta|regsvr32|wscript|cscript|bitsadmin|rundll32|msiexec).exe$')",
}
KEYWORDS = {
    "3f7c9e25-d1a8-4b6f-c2e0-8a5d3f7b9c1e": ["maximum authentication attempts exceeded", "too many authentication failures"],
    "9c3f5e27-b4d1-4a7c-8b2e-3c8f1d5a7b9e": ["new user:", "useradd", "new group:"],
    "7b2e4f18-a3c9-4d6b-8e1f-2a9c5d7b0e3f": ["accepted password for root", "accepted publickey for root",
                                             "session opened for user root"],
    "4a7c3d21-b2f1-4e8a-9c0d-5f8e2a1b3c4d": ["failed password", "authentication failure", "invalid user"],
    "2d8a6c14-e5b9-4f3c-9a7d-1b4e6c8f2a0d": ["command=/bin/bash", "command=/bin/sh", "command=/usr/bin/bash",
                                             "command=su -", "command=/bin/zsh"],
    "5e9b1d37-c6f2-4a8e-b3c5-7d0f2e4a8b1c": ["uid=0"],
}


def _has_any(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{w}')" for w in words) + ")"


@query("rule_scan_all", with_ev(select="\nUNION ALL\n".join(
    [f"SELECT '{r}' AS rule_id, hostname, count(*) AS matches, min(seq) AS first_seq, max(seq) AS last_seq FROM ev "
     f"WHERE {w} GROUP BY hostname" for r, w in MATCHES.items()]
    + [f"SELECT '{r}' AS rule_id, hostname, count(*) AS matches, min(seq) AS first_seq, max(seq) AS last_seq FROM ev "
       f"WHERE {_has_any('message', w)} GROUP BY hostname" for r, w in KEYWORDS.items()])))
def rule_scan_all(spark, sf_dir):
    """Every bundled rule over all events in one scan, matches per rule and host."""
    rules, _ = ru.load_rules()
    ids = F.array(*[F.lit(r.id) for r in rules])
    return (
        ru.match_rules(events(spark, sf_dir), rules)
        .groupBy("rule_ord", "hostname")
        .agg(F.count("*").alias("matches"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
        .select(F.element_at(ids, F.col("rule_ord") + 1).alias("rule_id"), "hostname", "matches", "first_seq", "last_seq"))


# Phrases that occur in the test texts.
TEXT_WORDS = {
    "contact": ["@", "MAILTO:"],
    "license": ["license", "copyright", "All rights reserved"],
    "script": ["<script", "onclick", "javascript:"],
    "plain": ["the and", "und der", "Que la"],
}


@query("keyword_rules", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS source, '{name}' AS rule, count(*) AS matches, sum({key}) AS key_sum FROM {t} "
    f"WHERE {_has_any(col, [w.lower() for w in words])} HAVING count(*) > 0"
    for t, col, key in (("documents", "text", "doc_id"), ("pages", "html", "page_id"), ("conversations", "text", "conv_id"))
    for name, words in TEXT_WORDS.items()))
def keyword_rules(spark, sf_dir):
    """Keyword lists over the whole texts of documents, pages and conversations."""
    texts = [("documents", "text", "doc_id"), ("pages", "html", "page_id"), ("conversations", "text", "conv_id")]
    lines = ru.union_all([
        table(spark, sf_dir, t).select(F.lit(t).alias("source"), F.col(c).alias("line"), F.col(k).alias("key"))
        for t, c, k in texts])
    hits = F.array_compact(F.array(*[
        F.when(ru.match_keywords(words, F.col("line")), F.lit(name)) for name, words in TEXT_WORDS.items()]))
    return (
        lines.select("source", "key", F.explode(hits).alias("rule"))
        .groupBy("source", "rule").agg(F.count("*").alias("matches"), F.sum("key").alias("key_sum")))


COUNT_RULE = {"title": "Failed logons", "level": "high", "tags": ["attack.credential_access", "attack.t1110"],
              "detection": {"selection": {"EventID": 4625}, "timeframe": "3d", "condition": "selection | count() >= 4"}}


def greedy_sql(name: str, source: str, condition: str, days: int, n: int) -> str:
    """CTEs for a counting rule per host and address: n matches within the days, then from zero."""
    held = f"CASE WHEN w.fire THEN [] ELSE list_filter(w.held, lambda x: x.us >= i.us - {days * DAY_US}) END"
    return f"""
{name}_in AS (SELECT hostname, source_ip, us, seq, row_number() OVER (PARTITION BY hostname, source_ip ORDER BY us, seq) AS rn
  FROM {source} WHERE {condition}),
{name}_walk AS (
  SELECT hostname, source_ip, rn, us, seq, [{{'us': us, 'seq': seq}}] AS held, false AS fire FROM {name}_in WHERE rn = 1
  UNION ALL
  SELECT i.hostname, i.source_ip, i.rn, i.us, i.seq,
    list_append({held}, {{'us': i.us, 'seq': i.seq}}), len({held}) + 1 >= {n}
  FROM {name}_walk w JOIN {name}_in i ON i.hostname = w.hostname AND i.source_ip = w.source_ip AND i.rn = w.rn + 1),
{name} AS (SELECT hostname, source_ip, us, held[1].seq AS lo, seq AS hi, len(held) AS n, held FROM {name}_walk WHERE fire)"""


C13_SQL = greedy_sql("c13", "ev", "event_id = 4625", 3, 4)


def count_rule() -> ru.Rule:
    return ru.parse_rule(COUNT_RULE, "failed-logons")


@query("rule_count_greedy", with_ev(C13_SQL, select="""
SELECT hostname || '|' || source_ip AS key_value, 'high' AS severity, make_timestamp(us) AS ts, lo AS seq_lo,
  hi AS seq_hi, n AS n_events, hostname AS first_host, 'T1110' AS techniques, 'Credential Access' AS tactics FROM c13"""))
def rule_count_greedy(spark, sf_dir):
    """Four failed logons per host and address within three days, then from zero."""
    alerts, _ = ru.detect(events(spark, sf_dir), [count_rule()])
    return alerts.select(
        "key_value", "severity", F.col("ts").cast("timestamp_ntz").alias("ts"), "seq_lo", "seq_hi", "n_events",
        "first_host", F.array_join("techniques", ",").alias("techniques"), F.array_join("tactics", ",").alias("tactics"))


# Stated here so the SQL side does not depend on the loader: severity, weight and two techniques of each bundled rule.
LISTED = [
    ("ssh-brute-force-001", "high", 4, "T1110,T1110.001"), ("login-after-failures-001", "high", 4, "T1110,T1078"),
    ("sudo-root-001", "medium", 3, "T1548,T1548.003"), ("win-audit-clear-001", "critical", 5, "T1070,T1070.001"),
    ("win-failed-logon-001", "high", 4, "T1110,T1110.003"), ("win-schtask-001", "medium", 3, "T1053,T1053.005"),
    ("win-lolbins-001", "high", 4, "T1218,T1059"),
    ("3f7c9e25-d1a8-4b6f-c2e0-8a5d3f7b9c1e", "high", 4, "T1110"), ("9c3f5e27-b4d1-4a7c-8b2e-3c8f1d5a7b9e", "medium", 3, "T1136,T1136.001"),
    ("7b2e4f18-a3c9-4d6b-8e1f-2a9c5d7b0e3f", "high", 4, "T1078.003"), ("4a7c3d21-b2f1-4e8a-9c0d-5f8e2a1b3c4d", "medium", 3, "T1110,T1110.001"),
    ("2d8a6c14-e5b9-4f3c-9a7d-1b4e6c8f2a0d", "high", 4, "T1548.003"), ("5e9b1d37-c6f2-4a8e-b3c5-7d0f2e4a8b1c", "critical", 5, "T1136,T1078.003"),
]
EVERY_MATCH = MATCHES | {r: _has_any("message", words) for r, words in KEYWORDS.items()}


@query("rules_by_severity", with_ev("c AS (" + "\nUNION ALL\n".join(
    f"SELECT '{r}' AS rule_id, '{s}' AS severity, {w} AS weight, '{t}' AS techniques, "
    f"(SELECT count(*) FROM ev WHERE {EVERY_MATCH[r]}) AS matches" for r, s, w, t in LISTED) + ")", select="SELECT * FROM c ORDER BY weight DESC"))
def rules_by_severity(spark, sf_dir):
    """All rules by severity with two techniques each, and how many events each matches."""
    rules, _ = ru.load_rules()
    counts = ru.match_rules(events(spark, sf_dir), rules).groupBy("rule_ord").agg(F.count("*").alias("matches"))
    listed = ru.rules_table(spark, rules).join(counts, "rule_ord", "left")
    return ru.rules_by_severity(listed).select(
        "rule_id", "severity", "weight", F.array_join("techniques", ",").alias("techniques"),
        F.coalesce("matches", F.lit(0)).alias("matches"))


# What some events of the table say and stand for instead, by their k, so that every bundled rule has something to find.
TOLD = {
    10: "error: maximum authentication attempts exceeded for ", 11: "useradd[7]: new user: UID=0, name=", 12: "Accepted publickey for root, key of ",
    13: "sudo: COMMAND=/bin/zsh by ", 14: "pam_unix(sshd:auth): authentication failure; uid=0 user=",
}
SEEN = {50: 1102, 51: 4698}
SPIKE = timedelta(days=60)


def told_events(spark, sf_dir):
    """The events with TOLD and SEEN in place."""
    ev = events(spark, sf_dir)
    k = F.element_at(F.split(F.try_element_at("raw", F.lit("TaskName")), r"\\"), -1).cast("int")
    message, event_id = F.col("message"), F.col("event_id")
    for at, text in TOLD.items():
        message = F.when(k == at, F.concat(F.lit(text), "username")).otherwise(message)
    for at, number in SEEN.items():
        event_id = F.when(k == at, number).otherwise(event_id)
    return ev.withColumns({"message": message, "event_id": event_id.cast("int")})


TOLD_SQL = ("told AS (SELECT * REPLACE (CASE k " + " ".join(f"WHEN {k} THEN '{t}' || username" for k, t in TOLD.items()) + " ELSE message END AS message, CASE k "
            + " ".join(f"WHEN {k} THEN {n}" for k, n in SEEN.items()) + " ELSE event_id END AS event_id) FROM ev)")
COUNTED = {"ssh-brute-force-001": 6, "win-failed-logon-001": 11}  # more than 5, more than 10


@query("bundled_rules_fire", with_ev(
    TOLD_SQL, *(greedy_sql(f"count{n}", "told", MATCHES[r], SPIKE.days, n) for r, n in COUNTED.items()),
    select="\nUNION ALL\n".join(
        [f"SELECT '{r}' AS rule_id, hostname || '|' || source_ip AS key_value, lo AS seq_lo, hi AS seq_hi, n AS n_events FROM count{n}"
         for r, n in COUNTED.items()]
        + [f"SELECT '{r}', hostname, seq, seq, 1 FROM told WHERE {w}" for r, w in EVERY_MATCH.items() if r not in COUNTED])))
def bundled_rules_fire(spark, sf_dir):
    """The alerts of all bundled rules; two of them fire by count."""
    alerts, _ = ru.detect(told_events(spark, sf_dir), ru.load_rules()[0], SPIKE)
    return alerts.select("rule_id", "key_value", "seq_lo", "seq_hi", "n_events")


INDEXED_USERS = 500


def user_rules(spark, sf_dir) -> list[ru.Rule]:
    """Four rules for each of the first INDEXED_USERS users of the events: on values, texts, exceptions and alternatives."""
    users = [r[0] for r in table(spark, sf_dir, "events").select("user_id").distinct().orderBy("user_id").limit(INDEXED_USERS).collect()]

    def detections(u: int) -> list[dict]:
        return [
            {"a": {"TargetUserName": f"USER{u}", "EventID": [4625, 4672]}, "condition": "a"},
            {"a": {"message|contains": f"for user{u} from 8.8", "status": "failure"}, "condition": "a"},
            {"a": {"user": f"user{u}", "channel": "security"}, "b": {"computer|endswith": ["1", "unknown"]}, "condition": "a and not b"},
            {"a": {"commandline|startswith": "/usr/bin", "user": f"user{u}"}, "b": {"message|startswith": "Page viewed", "user": f"user{u}"},
             "condition": "1 of them"},
        ]

    return [ru.parse_rule({"id": f"u{u}-{t}", "title": "t", "detection": d}, "r") for u in users for t, d in enumerate(detections(u))]


@query("rule_index_scan", with_ev(f"""
u AS (SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT {INDEXED_USERS}),
h AS (
  SELECT user_id, seq, 0 AS t FROM ev WHERE event_id IN (4625, 4672)
  UNION ALL SELECT user_id, seq, 1 FROM ev WHERE message LIKE '%for user%' AND source_ip LIKE '8.8%' AND status = 'failure'
  UNION ALL SELECT user_id, seq, 2 FROM ev WHERE channel = 'Security' AND NOT (hostname = 'host1' OR hostname = 'unknown')
  UNION ALL SELECT user_id, seq, 3 FROM ev WHERE command_line LIKE '/usr/bin%' OR kind = 'view')""",
    select="SELECT 'u' || user_id || '-' || t AS rule_id, seq FROM h JOIN u USING (user_id)"))
def rule_index_scan(spark, sf_dir):
    """C14: thousands of rules by the predicate-counting index, over all events."""
    rules = user_rules(spark, sf_dir)
    hits = match_indexed(events(spark, sf_dir), rules, carry=("seq",))
    ids = spark.createDataFrame([(i, r.id) for i, r in enumerate(rules)], "rule_ord int, rule_id string")
    return hits.join(ids, "rule_ord").select("rule_id", "seq")
