"""De-duplication, correlation, incidents, report, anomaly scoring, and whole runs with known results."""

import hashlib
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from nightwarden.operators import alerts as al
from nightwarden.operators import anomaly as an
from nightwarden.operators import correlate as co
from nightwarden.operators import rules as ru
from nightwarden.plans import report
from nightwarden.plans.analysis import AnalysisConfig, analyze, write
from nightwarden.sources import authlog

from . import helpers as h

OUTSIDE, DESK, HOST = "203.0.113.77", "192.168.4.4", "edge7"


def at_night(*entries):
    """Lines of one host, from (seconds after 23:10, process and message)."""
    start = datetime(2024, 3, 8, 23, 10)
    return [f"{start + timedelta(seconds=s):%b %d %H:%M:%S} {HOST} {text}" for s, text in entries]


def login(user, ip, good):
    return f"sshd[77]: {'Accepted' if good else 'Failed'} password for {user} from {ip} port 4022 ssh2"


def as_root(user, command):
    return f"sudo: {user} : TTY=pts/3 ; PWD=/home/{user} ; USER=root ; COMMAND={command}"


# Seven users are tried twice, four seconds apart; the third one works and becomes root; later a login from a desk.
STAFF = ["nora", "paul", "quinn", "rosa", "sam", "tess", "uma"]
SPRAY = at_night(
    *[(4 * i, login(STAFF[i % 7], OUTSIDE, False)) for i in range(14)], (58, login("quinn", OUTSIDE, True)),
    (64, as_root("quinn", "/bin/bash")), (300, login("nora", DESK, True)))

# One account is tried every two seconds for a minute and a half from two addresses in turn; nobody gets in.
GRIND = at_night(*[(2 * i, login("svc", [OUTSIDE, DESK][i % 2], False)) for i in range(45)])


def field_rules():
    return [r for r in ru.load_rules()[0] if "keywords" not in r.selections]


def run(spark, texts, **options):
    events = authlog.parse(h.lines(spark, texts)).cache()
    return events, analyze(events, AnalysisConfig(rules=field_rules(), use_anomaly=False, **options))


@pytest.fixture(scope="module")
def spray(spark):
    return run(spark, SPRAY)


def found(result):
    out = {}
    for r in result.alerts.collect():
        out.setdefault(r.rule_id, []).append((r.ts.strftime("%H:%M:%S"), r.n_events))
    return {k: sorted(v) for k, v in out.items()}


def test_spray(spray):
    events, result = spray
    assert events.count() == 17
    assert found(result) == {
        # the sixth failure fires and clears, the twelfth fires again in the same minute
        "ssh-brute-force-001": [("23:10:20", 6)],
        "login-after-failures-001": [("23:10:58", 1), ("23:15:00", 1)],
        "sudo-root-001": [("23:11:04", 1)],
        "threshold_brute_force_ip": [("23:10:52", 14)],  # the window from the first failure, up to its last
        "threshold_account_enum": [("23:10:16", 5)],  # the fifth user; the next five complete in the same minute
        "threshold_credential_stuffing": [("23:10:58", 15)],
        "threshold_after_hours_login": [("23:10:58", 1), ("23:15:00", 1)],
    }
    summary = result.summary.first()
    assert (summary.total_alerts, summary.incidents) == (9, 1)
    assert summary.critical + summary.high + summary.medium == 9
    incident = result.incidents.first()
    assert incident.alert_count == 9 and incident.name.endswith(f" — {HOST}")
    assert (incident.severity, incident.last_seen.strftime("%H:%M:%S")) == ("critical", "23:15:00")


def test_spray_detail_texts(spray):
    _, result = spray
    texts = {(r.rule_id, r.ts.strftime("%M")): r.description for r in result.alerts.collect()}
    assert texts["threshold_brute_force_ip", "10"].endswith(f"IP={OUTSIDE}, count=14 in 0:05:00")
    assert texts["threshold_account_enum", "10"].endswith(f"IP={OUTSIDE}, distinct_users=5")
    assert texts["threshold_credential_stuffing", "10"].endswith(f"IP={OUTSIDE}, failures=14, then success user=quinn")
    assert texts["threshold_after_hours_login", "15"].endswith("user=nora, hour=23:00 UTC")


def test_spray_rule_alerts_before_dedup(spark):
    events = authlog.parse(h.lines(spark, SPRAY))
    for parity in (True, False):
        alerts = ru.detect(events, field_rules(), parity=parity)[0].cache()
        assert {r.rule_id: r["count"] for r in alerts.groupBy("rule_id").count().collect()} == {
            "ssh-brute-force-001": 2, "login-after-failures-001": 2, "sudo-root-001": 1}


def test_grind(spark):
    events, result = run(spark, GRIND)
    assert events.count() == 45
    got = found(result)
    # the rule counts by host and address: 23 and 22 failures, four seconds apart, fire at every sixth, once a minute
    assert [t for t, _ in got["ssh-brute-force-001"]] == ["23:10:20", "23:10:22", "23:11:08", "23:11:10"]
    assert [n for _, n in got["threshold_brute_force_ip"]].count(23) == 1
    assert set(got) == {"ssh-brute-force-001", "threshold_brute_force_ip"}
    assert result.incidents.count() == 1


def test_anomalies_in_a_whole_run_and_sinks(spark, tmp_path):
    events = authlog.parse(h.lines(spark, GRIND))
    result = analyze(events, AnalysisConfig(rules=field_rules(), contamination=0.15, parity=True))
    assert result.alerts.filter("rule_id = 'ml_anomaly' AND severity = 'high'").count() == 45
    write(result, str(tmp_path / "out"), "json")
    assert spark.read.json(str(tmp_path / "out/alerts")).count() == result.alerts.count()
    assert spark.read.json(str(tmp_path / "out/summary")).first().events_processed == 45
    briefs = report.alert_briefs(result.alerts, result.evidence).collect()
    assert len(briefs) == result.alerts.count() and all("Event timeline:\n  [23:1" in r.brief for r in briefs)
    table = report.incident_rows(result.incidents, co.incident_entities(result.members, result.entities)).first()
    assert (table.hosts, table.first_seen) == (HOST, "2024-03-08 23:10")
    assert report.alert_listing(result.alerts).count() == 30
    assert [r.file_name for r in report.file_names(events).collect()] == ["f"]


def test_durations_as_text(spark):
    df = spark.createDataFrame([(3.14159,), (59.94,), (75.9,), (None,)], "s double")
    assert [r[0] for r in df.select(report.duration_text(F.col("s"))).collect()] == ["3.1s", "59.9s", "1m 15s", None]


# ---- correlation -----------------------------------------------------------------------------------------------

def random_alerts(seed, n=120):
    rng = random.Random(seed)
    us, out = h.US0, []
    for i in range(n):
        us += rng.choice([0, 60, 300, 900, 1700, 1900]) * 1_000_000
        kinds = rng.choice([["user"], ["host", "user"], ["ip"], ["host", "ip"], []])
        inds = {(k, f"{k}{rng.randint(0, 9)}") for k in kinds}
        if rng.random() < 0.3:
            inds.add(("host", "hub" if i % 3 else "unknown"))
        out.append((us, inds))
    return out


@pytest.fixture(scope="module", params=[3])
def correlated(spark, request):
    data = random_alerts(request.param)
    alerts = spark.createDataFrame(
        [(f"a{i}", us, 0, 0, i, "k", i) for i, (us, _) in enumerate(data)],
        "alert_id string, us long, src_rank int, rule_ord int, seq_hi long, key_value string, mark long")
    entities = spark.createDataFrame(
        [(f"a{i}", k, v, us, i) for i, (us, inds) in enumerate(data) for k, v in inds],
        "alert_id string, kind string, value string, first_us long, first_seq long")
    return data, alerts, entities


@pytest.mark.parametrize("group_edges", [12, 10**6])
def test_correlate_equals_the_sequential_definition(correlated, group_edges):
    data, alerts, entities = correlated
    width = 1_800_000_000
    want = h.loop_correlate([(us, {i for i in inds if i != ("host", "unknown")}) for us, inds in data], width)
    got = co.correlate(alerts, entities, timedelta(minutes=30), group_edges)
    assert [r.incident for r in got.orderBy("pos").collect()] == want


def test_entity_lists_and_names(spark, correlated):
    data, alerts, entities = correlated
    members = co.correlate(alerts, entities).cache()
    listed = co.incident_entities(members, entities)
    table = co.with_entity_lists(members.select("incident").distinct(), listed).collect()
    incident_of = {r.pos: r.incident for r in members.collect()}
    for row in table:
        want = []
        for pos, (_, inds) in enumerate(data, 1):
            if incident_of[pos] == row.incident:
                want += [v for k, v in sorted(inds) if k == "user" and v not in want]
        assert row.users == want
    top = {r.incident: r.users for r in co.top_entities(listed, "user", 2).collect()}
    assert top == {r.incident: ", ".join(r.users[:2]) for r in table if r.users}


def test_incident_name_without_tactics(spark):
    df = spark.createDataFrame([([], ["B", "C"], 3, "h"), ([], ["B"], 1, "h"), (["X", "Y", "Z"], ["B"], 1, None)],
                               "tactics array<string>, rule_names array<string>, alert_count long, first_host string")
    assert [r[0] for r in df.select(co.incident_name()).collect()] == ["B (+2 more)", "B", "X + Y — unknown"]


def test_dedup_keeps_the_first_of_a_minute(spark):
    base = ("r", "h1", "k1")
    df = spark.createDataFrame([
        (*base, h.US0 + s * 1_000_000, s, s) for s in (5, 1, 59, 60)] + [("r", "h1", "k2", h.US0, 9, 9)],
        "rule_id string, first_host string, key_value string, us long, seq_hi long, mark long").withColumn("ts", F.timestamp_micros("us"))
    assert sorted(r.mark for r in al.dedup(df).collect()) == [1, 9, 60]
    assert sorted(r.mark for r in al.dedup(df, parity=True).collect()) == [9, 60]


# ---- anomaly ---------------------------------------------------------------------------------------------------

def test_outliers_rank_on_top(spark):
    rows = [{"category": "network", "at": 36_000 + i, "username": "u", "source_ip": "10.0.0.1"} for i in range(400)]
    rows += [{"category": "authentication", "status": "failure", "event_id": 4625, "logon_type": 10, "at": 10_000 + i,
              "process_name": "C:\\x\\mimikatz.exe", "command_line": "c", "source_ip": "8.8.8.8"} for i in range(4)]
    scored = an.score_events(h.events(spark, rows), contamination=0.02).cache()
    worst = scored.orderBy("score").limit(4).collect()
    assert {r.seq for r in worst} == set(range(400, 404))
    assert all(-1 <= r.raw_score <= 0 for r in scored.collect())
    alerts, evidence = an.detect(h.events(spark, rows), contamination=0.02)
    assert {r.seq_lo for r in alerts.collect()} == {400, 401, 402, 403} == {r.seq for r in evidence.collect()}
    assert all(r.description.startswith("Anomaly score -0.") and "Process: C:\\x\\mimikatz.exe." in r.description
               for r in alerts.collect())


def test_too_few_events_give_no_scores(spark):
    assert an.score_events(h.events(spark, [{"at": i} for i in range(19)])).count() == 0
    assert an.score_events(h.events(spark, [{"at": i} for i in range(20)])).count() == 20


def drawn_per_tree(df):
    return {r.tree: r.n for r in df.groupBy("tree").agg(F.sum("drawn").alias("n")).collect()}


def test_tree_samples_are_whole_or_exact(spark):
    feats = an.vectors(an.features(h.events(spark, [{"at": i * 600} for i in range(300)])))
    assert drawn_per_tree(an.tree_samples(feats, 300, trees=5)) == dict.fromkeys(range(5), 256)
    small = feats.withColumn("n", F.lit(2).cast("long"))
    total = 2 * small.count()
    assert {r.drawn for r in an.tree_samples(small, total, trees=5).collect()} == {2}


def test_samples_are_the_smallest_draws(spark):
    """A vector of a third of the events and 300 rare ones, against all draws made one by one."""
    counts = {0: 500, **{i: 1 + i % 5 for i in range(1, 301)}}
    rows = [(*[float(v)] * len(an.FEATURES), n) for v, n in counts.items()]
    feats = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in an.FEATURES) + ", n long")
    got = {(r.tree, int(r.hour_of_day)): r.drawn for r in an.tree_samples(feats, sum(counts.values()), 4, 40).collect()}
    want = {}
    for tree in range(4):
        times = []
        for v, n in counts.items():
            name, at = "|".join([str(v)] * len(an.FEATURES)), 0.0
            for j in range(1, n + 1):
                u = (int(hashlib.md5(f"42|{tree}|{name}|{j}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                at += -math.log(u) / (n - j + 1)
                times.append((at, v))
        for _, v in sorted(times)[:40]:
            want[tree, v] = want.get((tree, v), 0) + 1
    assert got == want


def test_samples_follow_the_counts(spark):
    """One vector has 60,000 events of 120,000, ten others share the rest: each tree's sample is drawn from all of them."""
    rows = [(*[float(v)] * len(an.FEATURES), 60_000 if v == 0 else 6_000) for v in range(11)]
    feats = spark.createDataFrame(rows, ", ".join(f"{f} double" for f in an.FEATURES) + ", n long")
    drawn = an.tree_samples(feats, 120_000, trees=40)
    assert set(drawn_per_tree(drawn).values()) == {256}
    share = {int(r.hour_of_day): r.n / (40 * 256) for r in drawn.groupBy("hour_of_day").agg(F.sum("drawn").alias("n")).collect()}
    assert abs(share[0] - 0.5) < 0.02 and all(abs(share[v] - 0.05) < 0.01 for v in range(1, 11))


def test_leaves_hold_what_the_trees_drew(spark):
    rows = [{"at": i * 977, "source_ip": "8.8.8.8" if i % 7 else None, "event_id": 4620 + i % 9} for i in range(700)]
    distinct = an.vectors(an.features(h.events(spark, rows)))
    samples = an.tree_samples(distinct, 700, trees=6, sample=64).cache()
    nodes = an.grow(samples, 64).cache()
    reached = an.leaves(distinct, nodes, 6, 64).join(samples, ["tree", *an.FEATURES])
    got = {(r.tree, r.node): r.n for r in reached.groupBy("tree", "node").agg(F.sum("drawn").alias("n")).collect()}
    assert got == {(r.tree, r.node): r.size for r in nodes.filter("feature = -1").collect()}
    assert {r.size for r in nodes.filter("node = 0").collect()} == {64}
    plan = an.score_vectors(distinct, nodes, 6, 64)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInPandas" not in plan


def test_scores_do_not_depend_on_partitioning(spark):
    rows = [{"at": i * 977, "source_ip": "8.8.8.8" if i % 7 else None, "event_id": 4620 + i % 9} for i in range(500)]
    first, second = (
        {r.seq: round(r.score, 9) for r in an.score_events(h.spread(h.events(spark, rows), n)).collect()} for n in (1, 6))
    assert first == second


def test_event_id_buckets(spark):
    ids = [None, 4624, 4625, 4626, 4688, 4700, 4702, 4703, 4720, 7045, 1100, 1102, 1]
    df = spark.createDataFrame([(i,) for i in ids], "i int")
    assert [r[0] for r in df.select(an.event_id_bucket(F.col("i"))).collect()] == [0, 1, 2, 1, 3, 4, 4, 8, 5, 6, 7, 7, 8]
    assert [r[0] for r in df.select(an.event_id_bucket(F.col("i"), parity=True)).collect()][2] == 1
