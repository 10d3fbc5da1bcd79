"""Registered queries against DuckDB over the smallest tables; the slow ones are left to the full check."""

import os

import pytest

import __spark_entry__ as entry
from nightwarden.catalog import ORACLES, QUERIES

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
TABLES = ("events documents pages conversations labels benchmark").split()
QUICK = [
    "auth_flags", "rule_condition_mix", "rule_scan_all", "keyword_rules", "rules_by_severity", "authlog_event_mix",
    "json_category_status", "winxml_normalize", "brute_force", "brute_force_unbounded", "process_burst", "anomaly_features",
    "numbered_actions", "activity_sessions", "rule_index_scan", "bundled_rules_fire",
    "forest_samples", "forest_nodes", "forest_scores", "isolation_forest",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def canonical(rows):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = entry.queries()[name](spark, FOLDER)
    want = con.sql(f"SELECT {', '.join(sorted(got.columns))} FROM ({entry.oracle_sql()[name]})")
    assert canonical(map(tuple, got.select(*sorted(got.columns)).collect())) == canonical(want.fetchall())


def test_every_bundled_rule_fires(spark):
    rows = entry.queries()["bundled_rules_fire"](spark, "/root/testdata/sf0.01").groupBy("rule_id").max("n_events").collect()
    assert len(rows) == 13 and {r.rule_id: r[1] for r in rows}["win-failed-logon-001"] == 11


def test_registry_is_consistent(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) == set(ORACLES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
