"""The ordered primitives and stateful detectors against plain loops, on random sequences cut into tiny chunks."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from nightwarden.operators import ordered as o
from nightwarden.operators import rules as ru
from nightwarden.operators import thresholds as th

from . import helpers as h

WIDTH = 60_000_000


def random_rows(seed, keys=25, per_key=70, ties=True):
    rng = random.Random(seed)
    out, seq = [], 0
    for key in range(keys):
        us = h.US0
        for _ in range(rng.randint(1, per_key)):
            us += rng.choice([0, 1_000_000, 5_000_000, 20_000_000, 61_000_000] if ties else [1_000_000, 30_000_000])
            out.append({"key": f"k{key}", "us": us, "seq": seq, "value": f"v{rng.randint(0, 6)}", "failed": rng.random() < 0.75})
            seq += 1
    # One key owns most rows.
    us = h.US0
    for _ in range(900):
        us += rng.choice([0, 100_000, 3_000_000])
        out.append({"key": "hot", "us": us, "seq": seq, "value": f"v{rng.randint(0, 4)}", "failed": rng.random() < 0.75})
        seq += 1
    return out


def by_key(data):
    groups = {}
    for r in sorted(data, key=lambda r: (r["us"], r["seq"])):
        groups.setdefault(r["key"], []).append(r)
    return groups


@pytest.fixture(scope="module", params=[1])
def data(request):
    return random_rows(request.param)


@pytest.fixture(scope="module")
def df(spark, data):
    return h.spread(spark.createDataFrame(data, "key string, us long, seq long, value string, failed boolean"), 5).cache()


def test_running_count(df, data):
    got = h.rows(o.running_count(df, ["key"], "n", flag=F.col("failed")), "key", "seq", "n")
    want = []
    for key, rows in by_key(data).items():
        n = 0
        for r in rows:
            n += r["failed"]
            want.append((key, r["seq"], n))
    assert got == sorted(want)


def test_running_count_spreads_one_key_at_one_time(spark):
    """A third of the rows has one key and one time; rows without key or time have no place."""
    n = 30_000
    data = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("key"),
        F.when(F.col("id") % 3 == 0, 86_400_000_000).otherwise(F.col("id") * 977 % 86_400_000_000).alias("us"),
        ((F.col("id") * 7_919) % n).alias("seq"))
    lost = data.limit(5).select("key", F.lit(None).cast("long").alias("us"), "seq").unionByName(
        data.limit(5).select(F.lit(None).cast("string").alias("key"), "us", "seq"))
    settings = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        table = data.unionByName(lost)
        sizes = [r["count"] for r in o.counted_ranges(table, ["key"], ["us", "seq"], F.lit(1).cast("long")).groupBy("__range").count().collect()]
        got = o.running_count(table, ["key"], "rank")
        w = Window.partitionBy("key").orderBy("us", "seq")
        assert len(sizes) > 12 and sum(sizes) == n and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
        assert got.count() == n
        assert got.exceptAll(data.withColumn("rank", F.row_number().over(w).cast("long"))).count() == 0
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


def test_running_count_without_keys(spark):
    data = spark.range(1_000).select((F.col("id") % 10).alias("us"), F.col("id").alias("seq"))
    got = [(r.us, r.seq) for r in o.running_count(data, [], "rank").orderBy("rank").collect()]
    assert got == sorted(got) and len(got) == 1_000
    assert o.running_count(data.limit(0).withColumn("key", F.lit("a")), ["key"], "rank").count() == 0


@pytest.mark.parametrize("offset", [3, -3])
def test_shifted(df, data, offset):
    ranked = o.running_count(df, ["key"], "rank")
    got = {(r.key, r.seq): r.out for r in o.shifted(ranked, ["key"], "us", offset, "out", chunk_rows=7).collect()}
    for key, rows in by_key(data).items():
        for i, r in enumerate(rows):
            j = i + offset
            assert got[key, r["seq"]] == (rows[j]["us"] if 0 <= j < len(rows) else None)
    assert len(got) == len(data)


def test_gap_sessions(df, data):
    want = {}
    for key, rows in by_key(data).items():
        start, last = None, None
        for r in rows:
            if last is None or r["us"] - last > WIDTH:
                start = r["us"]
            last = r["us"]
            want[key, r["seq"]] = start
    got = {(r.key, r.seq): r.session for r in o.gap_sessions(df, ["key"], WIDTH).collect()}
    assert got == want
    summary = {(r.key, r.first_us): r.n_events for r in o.session_summary(df, ["key"], WIDTH).collect()}
    counts = {}
    for (key, _), start in want.items():
        counts[key, start] = counts.get((key, start), 0) + 1
    assert summary == counts


@pytest.mark.parametrize("chunk", [3, 100_000])
def test_distinct_picks(df, data, chunk):
    ranked = o.running_count(df, ["key"], "rank")
    got = h.rows(o.distinct_picks(ranked, ["key"], "value", 4, chunk), "key", "rank")
    want = []
    for key, rows in by_key(data).items():
        position = {r["seq"]: i for i, r in enumerate(rows, 1)}
        want += [(key, position[last]) for _, last, _ in h.loop_distinct([(r["value"], r["seq"]) for r in rows], 4)]
    assert got == sorted(want)


@pytest.mark.parametrize("chunk", [4, 100_000])
def test_spaced_picks(df, data, chunk):
    ranked = o.running_count(df, ["key"], "rank").filter("failed").select("key", "rank")
    got = h.rows(o.spaced_picks(ranked, ["key"], 4, chunk), "key", "rank")
    want = []
    for key, rows in by_key(data).items():
        allowed = 1
        for i, r in enumerate(rows, 1):
            if r["failed"] and i >= allowed:
                want.append((key, i))
                allowed = i + 4
    assert got == sorted(want)


def as_events(spark, data, **fixed):
    out = []
    for r in data:
        make = h.failure if r["failed"] else h.success
        out.append(make(ip=r["key"], user=r["value"], host=r["value"], at=(r["us"] - h.US0) / 1e6, seq=r["seq"], **fixed))
    return h.spread(h.events(spark, out), 3)


@pytest.fixture(scope="module")
def ev(spark, data):
    return as_events(spark, data).cache()


CFG = th.ThresholdConfig(window=timedelta(seconds=60), failures=5, enum_users=4, lateral_hosts=4, chunk_rows=8)


def alerts(ev, rule, cfg=CFG):
    found = th.detect_one(ev, rule, cfg)
    return h.rows(found, "key_value", "seq_lo", "seq_hi", "n_events")


def want_per_key(data, run):
    return sorted((key, *hit) for key, rows in by_key(data).items() for hit in run(rows))


def test_brute_force(ev, data):
    want = want_per_key(data, lambda rows: h.loop_anchors([(r["us"], r["seq"]) for r in rows if r["failed"]], 5, WIDTH))
    assert alerts(ev, "threshold_brute_force_ip") == want and want


def test_account_enum(ev, data):
    want = want_per_key(data, lambda rows: h.loop_distinct([(r["value"], r["seq"]) for r in rows if r["failed"]], 4))
    assert alerts(ev, "threshold_account_enum") == want and want


def test_credential_stuffing(ev, data):
    want = want_per_key(data, lambda rows: h.loop_stuffing([(r["us"], r["seq"], r["failed"]) for r in rows], 5, WIDTH))
    assert alerts(ev, "threshold_credential_stuffing") == want and want


def test_lateral_movement(spark, data):
    swapped = [{**r, "failed": False} for r in data]
    ev = h.spread(h.events(spark, [
        h.success(user=r["key"], host=r["value"], at=(r["us"] - h.US0) / 1e6, seq=r["seq"]) for r in swapped]), 3)
    want = want_per_key(swapped, lambda rows: h.loop_diverse([(r["us"], r["seq"], r["value"]) for r in rows], 4, WIDTH))
    assert alerts(ev, "threshold_lateral_movement") == want and want


def test_process_burst_and_priv_esc(spark, data):
    ev = h.spread(h.events(spark, [
        {"category": "process", "hostname": r["key"], "username": r["key"], "tags": ["su"], "seq": r["seq"],
         "at": (r["us"] - h.US0) / 1e6} for r in data]), 3)
    cfg = th.ThresholdConfig(window=timedelta(seconds=60), process_burst=6, priv_esc=6, chunk_rows=20)
    want = want_per_key(data, lambda rows: h.loop_anchors([(r["us"], r["seq"]) for r in rows], 6, WIDTH)[:1])
    assert alerts(ev, "threshold_process_burst", cfg) == want and want
    assert alerts(ev, "threshold_repeated_privilege_escalation", cfg) == want


def test_count_rule(ev, data):
    rule = ru.parse_rule({"title": "t", "detection": {
        "selection": {"status": "failure"}, "timeframe": "60s", "condition": "selection | count() > 3"}}, "t")
    want, groups = [], {}
    for r in sorted(data, key=lambda r: (r["us"], r["seq"])):
        if r["failed"]:
            groups.setdefault((r["value"], r["key"]), []).append((r["us"], r["seq"]))
    for (host, ip), times in groups.items():
        want += [(f"{host}|{ip}", *hit) for hit in h.loop_count(times, 4, WIDTH)]
    found = ru.to_alerts(ru.count_evidence(ev, rule, chunk_rows=8), ru.rules_table(ev.sparkSession, [rule]))
    assert h.rows(found, "key_value", "seq_lo", "seq_hi", "n_events") == sorted(want) and want


@pytest.mark.parametrize("parts", [1, 8])
def test_same_result_for_any_partitioning(ev, parts):
    base = alerts(ev, "threshold_credential_stuffing")
    assert alerts(h.spread(ev, parts), "threshold_credential_stuffing") == base
