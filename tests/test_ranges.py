"""Overlapping windows kept as ranges of ranks, against plain loops."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from nightwarden.operators import alerts as al
from nightwarden.operators import correlate as co
from nightwarden.operators import ordered as o
from nightwarden.operators import thresholds as th
from nightwarden.plans.analysis import AnalysisConfig, analyze

from . import helpers as h

N, WIDTH = 4, 120_000_000
CFG = th.ThresholdConfig(window=timedelta(seconds=120), failures=N, chunk_rows=16)
RULE = "threshold_brute_force_ip"


@pytest.fixture(scope="module")
def rows():
    """Two addresses; times that several rows share, rows that come twice, seqs that are null or come twice."""
    rng = random.Random(5)
    out, at = [], 0
    for seq in range(260):
        at += rng.choice([0, 0, 1, 7, 20, 90])
        row = h.failure(ip=f"10.0.0.{rng.randint(1, 2)}", user=f"u{rng.randint(0, 9)}", host=f"h{rng.randint(0, 3)}", at=at, seq=seq)
        row["seq"] = None if rng.random() < 0.1 else 7 if rng.random() < 0.05 else seq
        out += [row] * (2 if rng.random() < 0.2 else 1)
    return out


def plain(rows):
    """Evidence of every (address, seq of the opening row), by definition; a null counts as the smallest."""
    found = {}
    for ip in {r["source_ip"] for r in rows}:
        mine = sorted(((h.US0 + r["at"] * 1_000_000, -1 if r["seq"] is None else r["seq"], r["hostname"], r["username"])
                       for r in rows if r["source_ip"] == ip))
        opened = {}
        for a, b in zip(mine, mine[N - 1:]):
            if b[0] - a[0] <= WIDTH:
                opened.setdefault(a[0] // 60_000_000, a)
        for us, seq, *_ in opened.values():
            held = [r for r in mine if us < r[0] <= us + WIDTH or (r[0] == us and seq >= 0 and r[1] >= seq)]
            found.setdefault((ip, seq), []).extend(held)
    return {k: sorted(v) for k, v in found.items() if v}


def test_alerts_of_ranges_equal_those_of_their_evidence(spark, rows):
    want = {(ip, mark, len(v), v[0][1], v[0][2], v[-1][0], v[-1][1]) for (ip, mark), v in plain(rows).items()}
    found = th.find(h.spread(h.events(spark, rows), 3), {RULE: CFG})
    columns = ["key_value", "mark", "n_events", "seq_lo", "first_host", "us", "seq_hi"]
    assert {tuple(-1 if v is None else v for v in r) for r in found.alerts().select(columns).collect()} == want and len(want) > 40
    rolled = al.roll_up(found.evidence()).select(columns)
    assert {tuple(-1 if v is None else v for v in r) for r in rolled.collect()} == want


@pytest.mark.parametrize("first", [None, 1, 3])
def test_rows_of_ranges(spark, rows, first):
    found = th.find(h.events(spark, rows), {RULE: CFG})
    got = {}
    for r in found.evidence(first).collect():
        got.setdefault((r.key_value, -1 if r.mark is None else r.mark), []).append((r.us, -1 if r.seq is None else r.seq))
    for name, held in plain(rows).items():
        held = [r[:2] for r in held]
        assert sorted(got[name])[:first] == held[:first]
        assert first or len(got[name]) == len(held)
    assert len(got) == len(plain(rows))


def test_overlapping_windows_cost_a_row_each(spark):
    """A thousand windows over the same thousand rows: nothing written grows with their product."""
    found = th.find(h.events(spark, [h.failure(at=60 * i) for i in range(1_000)]), {RULE: th.ThresholdConfig(window=timedelta(days=1))})
    assert found.listed is None and found.ranges[RULE].spans.count() == 991 and found.ranges[RULE].rows.count() == 1_000
    assert found.alerts().agg(F.sum("n_events")).first()[0] == sum(range(10, 1_001))
    assert found.evidence(15).count() < 15_000


@pytest.mark.parametrize("first,last", [(1, 1), (1, 64), (2, 64), (3, 17), (64, 65), (33, 200), (200, 200)])
def test_blocks_cover_a_range_once(spark, first, last):
    df = spark.range(1).select(o.range_blocks(F.lit(first).cast("long"), F.lit(last).cast("long")).alias("b"))
    blocks = [tuple(b) for b in df.first().b]
    assert sorted(r for level, b in blocks for r in range((b << level) + 1, ((b + 1) << level) + 1)) == list(range(first, last + 1))
    assert len(blocks) <= 2 * (last - first + 1).bit_length()
    above = spark.range(1).select(o.blocks_of(F.lit(last).cast("long"), F.lit(9)).alias("b")).first().b
    assert [tuple(b) for b in above] == [(level, (last - 1) >> level) for level in range(10)]


# ---- alerts that share blocks of rows -----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def overlapping(spark, rows):
    """Found ranges, a few listed alerts beside them, and all evidence by definition."""
    ev = h.events(spark, rows + [h.success(ip=f"10.0.0.{i % 3}", user=f"u{i}", host=f"h{i % 5}", at=37 * i, seq=1000 + i) for i in range(60)])
    found = th.find(ev, {RULE: CFG, "threshold_after_hours_login": CFG})
    return found, al.dedup(found.alerts()).cache()


def test_shared_entities_equal_listed_ones(overlapping):
    found, alerts = overlapping
    columns = ["alert_id", "kind", "value", "first_us", "first_seq"]
    want = al.entities(found.evidence()).join(alerts.select("alert_id"), "alert_id", "left_semi")
    assert set(map(tuple, found.entities().of(alerts).rows().select(columns).collect())) == set(map(tuple, want.select(columns).collect()))
    assert found.entities().of(alerts).rows().count() == want.count() > 100


def test_entities_beside_alerts_equal_the_listed_ones(overlapping):
    found, alerts = overlapping
    columns = ["alert_id", "n_events", "kind", "value", "first_us", "first_seq"]
    want = found.entities().of(alerts).rows().join(alerts.select("alert_id", "n_events"), "alert_id").select(columns)
    got = found.entities_beside(alerts.select("alert_id", "n_events")).select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_entities_of_ranges_are_not_summed_up_after_the_join_that_lists_them(spark):
    found = th.find(h.events(spark, [h.failure(user=f"u{i % 700}", at=60 * i) for i in range(1_000)]), {RULE: th.ThresholdConfig(window=timedelta(days=1))})
    listed = found.entities_beside(found.alerts().select("alert_id"))
    plan = listed._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[:plan.index("__part")]
    assert listed.count() == sum(min(1_000 - i, 700) + 2 for i in range(991))


@pytest.mark.parametrize("chunk_rows", [1, 3, 64])
def test_first_rows_of_values_in_spans(spark, chunk_rows):
    rng = random.Random(chunk_rows)
    values = {k: [rng.choice("abcdef") if i % 9 else "z" for i in range(40)] for k in "pq"}
    spans = [(k, a, b) for k in "pq" for a in range(1, 41, 3) for b in [rng.randint(a, 40)]]
    want = {(k, a, b, v): min(r for r in range(a, b + 1) if values[k][r - 1] == v) for k, a, b in spans for v in values[k][a - 1:b]}
    rows = spark.createDataFrame([(k, "user", v, i + 1) for k in "pq" for i, v in enumerate(values[k])], "key string, kind string, value string, rank long")
    got = o.firsts_in_spans(spark.createDataFrame(spans, "key string, first long, last long"), rows, "key", chunk_rows).collect()
    assert {(r.key, r.first, r.last, r.value): r.rank for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("minutes,group_edges", [(1, 5), (1, 10**6), (30, 5)])
def test_correlation_over_blocks_equals_the_sequential_definition(overlapping, minutes, group_edges):
    found, alerts = overlapping
    entities, window = found.entities().of(alerts), timedelta(minutes=minutes)
    members = co.correlate(alerts, entities, window, group_edges).cache()
    held = {}
    for r in al.indicators(al.entities(found.evidence())).collect():
        held.setdefault(r.alert_id, set()).add((r.kind, r.value))
    time = {r.alert_id: r.us for r in alerts.collect()}
    order = [r.alert_id for r in members.orderBy("pos").collect()]
    want = h.loop_correlate([(time[a], held.get(a, set())) for a in order], minutes * 60_000_000)
    assert [r.incident for r in members.orderBy("pos").collect()] == want and len(set(want)) > 1
    listed = co.incident_entities(members, found.entities().of(alerts).rows()).collect()
    assert sorted(map(str, co.incident_entities(members, entities).collect())) == sorted(map(str, listed))
    assert sorted(map(str, co.correlate_components(alerts, entities, window).collect())) == sorted(
        map(str, co.correlate_components(alerts, entities.rows(), window).collect()))


def test_counted_timeline_equals_all_evidence(overlapping):
    found, alerts = overlapping
    members = co.correlate(alerts, found.entities().of(alerts), timedelta(minutes=1)).cache()
    columns = ["incident", "us", "seq", "hostname", "username", "source_ip", "category"]
    want = co.timeline(members, found.evidence(), al.alert_id()).groupBy(columns).agg(F.count("*").alias("n"))
    got = found.timeline(members).groupBy(columns).agg(F.sum("times").alias("n"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_alerts_over_the_same_rows_share_blocks(spark):
    """A thousand alerts with up to a thousand users each: links grow with the alerts, not with alerts times users."""
    found = th.find(h.events(spark, [h.failure(user=f"u{i}", at=60 * i) for i in range(1_000)]), {
        RULE: th.ThresholdConfig(window=timedelta(days=1)), "threshold_after_hours_login": CFG})
    entities = found.entities()
    assert entities.uses.count() + entities.blocks.count() < 991 * 20 + 1_000 * 3 * 10
    members = co.correlate(found.alerts(), entities, group_edges=100)
    assert {r.incident for r in members.collect()} == {1} and members.count() == 991


def test_evidence_of_chosen_alerts_lists_no_other_ranges(spark, rows):
    found = th.find(h.spread(h.events(spark, rows), 3), {RULE: CFG})
    alerts = found.alerts().withColumn("alert_id", al.alert_id())
    some = alerts.filter("mark % 3 = 0").cache()
    chosen = found.of(some)
    assert 0 < chosen.ranges[RULE].spans.count() == some.select("key_value", "mark").distinct().count() < found.ranges[RULE].spans.count()
    want = found.evidence().withColumn("alert_id", al.alert_id()).join(some.select("alert_id"), "alert_id", "left_semi").drop("alert_id")
    got = chosen.evidence()
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_a_run_chooses_ranges_before_it_lists_them(spark, rows):
    """The evidence of a run is not joined by alert once it is listed."""
    events = h.spread(h.events(spark, rows), 3)
    result = analyze(events, AnalysisConfig(rules=[], thresholds=CFG, use_anomaly=False))
    plan = result.evidence._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.index("__part"):]  # below the join that lists rows, as a plan reads from the result down
    kept = {r.alert_id for r in result.alerts.collect()}
    assert {r[0] for r in result.evidence.select(al.alert_id()).distinct().collect()} == kept
