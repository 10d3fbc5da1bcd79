"""Rule loading, field tests, conditions."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from nightwarden.functions.network import is_private_ip
from nightwarden.functions.severity import attack_tactics, attack_techniques, level_to_severity, severity_weight
from nightwarden.operators import rules as ru

from . import helpers as h

ROWS = [
    {"event_id": 4625, "hostname": "Web1", "username": "Bob", "command_line": "C:\\X\\cmd.exe /c whoami", "status": "failure",
     "tags": ["ssh_failed", "Other"], "message": "Failed password for Bob", "raw": {"TaskName": "\\Up", "line": "raw: UID=0"}},
    {"event_id": None, "hostname": "web2", "username": None, "command_line": None, "status": None, "tags": [], "message": "quiet"},
    {"event_id": 4624, "hostname": "web3", "username": "al", "command_line": "", "status": "success", "tags": ["sudo"],
     "message": "Accepted publickey for root"},
]


def matched(spark, detection):
    rule = ru.parse_rule({"title": "t", "detection": detection}, "t")
    return [r.seq for r in ru.match_rules(h.events(spark, ROWS), [rule]).orderBy("seq").collect()]


@pytest.mark.parametrize("fields, want", [
    ({"EventID": 4625}, [0]), ({"eventid": "4625"}, [0]), ({"EventID": ["4624", 4625]}, [0, 2]), ({"EventID": "04625"}, []),
    ({"Computer": "WEB1"}, [0]), ({"User": ["bob", "AL"]}, [0, 2]), ({"CommandLine|contains": ["CMD.exe", "zz"]}, [0]),
    ({"CommandLine|contains|all": ["cmd", "who"]}, [0]), ({"CommandLine|contains|all": ["cmd", "zz"]}, []),
    ({"CommandLine|startswith": "c:\\x"}, [0]), ({"CommandLine|endswith": ["WHOAMI"]}, [0]), ({"message|re": "for (bob|root)$"}, [0, 2]),
    ({"message|re": ["^quiet$", "publickey"]}, [1, 2]), ({"tags|contains": "SSH"}, [0]), ({"tags": "other"}, [0]),
    ({"TaskName": "\\up"}, [0]), ({"User": None}, [1]), ({"User": [None, "al"]}, [1, 2]), ({"NoSuchField": "x"}, []),
    ({"status": "failure", "EventID": 4625}, [0]), ({"status": "failure", "EventID": 4624}, []),
])
def test_fields(spark, fields, want):
    assert matched(spark, {"selection": fields}) == want


SELECTIONS = {"a": {"EventID": 4625}, "b": {"status": "success"}, "sel_x": {"Computer": "web1"}, "sel_y": {"Computer": "web2"}}


@pytest.mark.parametrize("condition, want", [
    ("a", [0]), ("a or b", [0, 2]), ("a and b", []), ("not a", [1, 2]), ("not a and not b", [1]), ("a or b and sel_x", [0]),
    ("(a or b) and not sel_x", [2]), ("1 of sel_*", [0, 1]), ("all of sel_*", []), ("1 of them", [0, 1, 2]), ("NOT (A OR B)", [1]),
])
def test_conditions(spark, condition, want):
    assert matched(spark, {**SELECTIONS, "condition": condition}) == want


def test_keywords(spark):
    assert matched(spark, {"keywords": ["uid=0", "FOR ROOT"], "condition": "keywords"}) == [0, 2]


@pytest.mark.parametrize("detection", [
    {"selection": {"a|base64": "x"}}, {"selection": {"a|all": "x"}}, {"selection": {"a|re": "("}}, {"selection": "text"},
    {"selection": {"a": 1}, "condition": "other"}, {"selection": {"a": 1}, "condition": "selection | count() < 5"},
    {"selection": {"a": 1}, "condition": "selection; drop"}, {"selection": {"a": 1}, "condition": "selection | count(x) by y > 5"},
    {"selection": {"a": 1}, "condition": "1 of zzz*"}, {"selection": {"a": 1}, "timeframe": "soon"},
])
def test_unusable_rules_are_rejected(detection):
    with pytest.raises(ru.RuleError):
        ru.parse_rule({"detection": detection}, "t")


@pytest.mark.parametrize("sign, n, parity", [(">", 6, 5), (">=", 5, 5), ("==", 5, 5)])
def test_count_threshold(sign, n, parity):
    rule = ru.parse_rule({"detection": {"selection": {"a": 1}, "condition": f"selection | count() {sign} 5"}}, "t")
    assert (rule.threshold(), rule.threshold(parity=True)) == (n, parity)


def test_loading_reports_broken_files(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.yml").write_text("detection:\n  selection:\n    EventID: 1\n")
    (tmp_path / "sub/a.yaml").write_text("title: T\nid: x\ndetection:\n  keywords: [a]\n  condition: keywords\n")
    (tmp_path / "c.yml").write_text("title: none\n")
    (tmp_path / "d.yml").write_text("a: [")
    (tmp_path / "e.txt").write_text("detection: {}")
    rules, rejected = ru.load_rules(tmp_path)
    assert [(r.id, r.title) for r in rules] == [("b", "b"), ("x", "T")]
    assert [Path(p).name for p, _ in rejected] == ["c.yml", "d.yml"]


def test_bundled_rules_all_load(spark):
    rules, rejected = ru.load_rules()
    assert len(rules) == 13 and rejected == []
    top = ru.rules_by_severity(ru.rules_table(spark, rules)).collect()
    assert [r.weight for r in top] == sorted((r.weight for r in top), reverse=True)
    assert all(len(r.techniques) <= 2 for r in top)


def test_more_rules_than_one_scan_takes(spark, monkeypatch):
    monkeypatch.setattr(ru, "RULES_PER_SCAN", 2)
    rules = [ru.parse_rule({"detection": {"selection": {"EventID": i}}}, str(i)) for i in (4625, 1, 4624, 2, 4625)]
    got = ru.match_rules(h.events(spark, ROWS), rules).select("seq", "rule_ord").collect()
    assert sorted(map(tuple, got)) == [(0, 0), (0, 4), (2, 2)]


def test_severity_and_tags(spark):
    df = spark.createDataFrame([("critical",), ("HIGH",), ("informational",), ("info",), (None,)], "level string")
    assert [tuple(r) for r in df.select(level_to_severity(F.col("level")).alias("s")).select("s", severity_weight(F.col("s"))).collect()] == [
        ("critical", 5), ("high", 4), ("info", 1), ("medium", 3), ("medium", 3)]
    tags = F.array(*map(F.lit, ["attack.t1110.001", "attack.lateral_movement", "car.1", "attack.t1"]))
    row = spark.range(1).select(attack_techniques(tags).alias("a"), attack_tactics(tags).alias("b")).first()
    assert (row.a, row.b) == (["T1110.001", "T1"], ["Lateral Movement"])


@pytest.mark.parametrize("ip, private", [
    ("10.1.2.3", True), ("8.8.8.8", False), ("172.15.0.1", False), ("172.31.255.255", True), ("192.168.1.1", True), ("127.0.0.1", True),
    ("203.0.113.9", True), ("198.19.0.1", True), ("100.64.0.1", False), ("224.0.0.1", False), ("240.0.0.1", True), ("192.0.0.9", False),
    ("192.0.0.8", True), ("1.2.3", True), ("1.2.3.256", True), ("01.2.3.4", True), ("host-a", True), ("::1", True), ("fe80::1", True),
    ("fd00::1", True), ("2001:db8::1", True), ("2606:4700::1111", False), ("2001:4860:4860::8888", False)])
def test_private_addresses(spark, ip, private):
    assert spark.range(1).select(is_private_ip(F.lit(ip))).first()[0] is private
