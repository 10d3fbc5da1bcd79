"""Parsers and file reading."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from nightwarden.sources import authlog, jsonlog, lines as ln, winxml

from . import helpers as h

HEAD = "Jun 15 02:30:01 web1 "


@pytest.mark.parametrize("body, want", [
    ("sshd[1]: Failed password for invalid user bob from 10.1.2.3 port 22 ssh2",
     ("ssh_failed", "authentication", "failure", "bob", "10.1.2.3", None)),
    ("sshd[1]: Accepted publickey for bob from fe80::1 port 22 ssh2",
     ("ssh_success", "authentication", "success", "bob", "fe80::1", None)),
    ("sshd[1]: Invalid user bob from 10.1.2.3 port 22",
     ("ssh_invalid_user", "authentication", "failure", "bob", "10.1.2.3", None)),
    ("sudo: bob : TTY=pts/0 ; PWD=/tmp ; USER=root ; COMMAND=/bin/bash -i",
     ("sudo", "process", "success", "bob", None, "/bin/bash -i")),
    ("sudo[77]: bob : TTY=pts/0 ; PWD=/tmp ; USER=root ; COMMAND=/bin/ls",
     ("sudo", "process", "success", "bob", None, "/bin/ls")),
    ("su[9]: Successful su for root by bob", ("su", "authentication", "success", "root", None, None)),
    ("su[9]: Failed su for root by bob", ("su", "authentication", "failure", "root", None, None)),
    ("sshd[1]: pam_unix(sshd:auth): authentication failure; logname= uid=0 euid=0 tty=ssh ruser= rhost=10.1.2.3  user=bob",
     ("pam_failure", "authentication", "failure", "bob", "10.1.2.3", None)),
    ("useradd[7]: new user: name=bob, UID=1001, GID=1001, home=/home/bob",
     ("user_created", "system", "success", "bob", None, None)),
    ("CRON[5]: (root) CMD (/usr/bin/backup)", ("cron", "process", "success", "root", None, "/usr/bin/backup")),
    ("systemd-logind[2]: session opened for x", (None, "system", None, None, None, None)),
    ("systemd[1]: Started daily cleanup", None),
])
def test_auth_patterns(spark, body, want):
    got = authlog.parse(h.lines(spark, [HEAD + body])).selectExpr(
        "try_element_at(tags, 1) AS tag", "category", "status", "username", "source_ip", "command_line",
        "hostname", "cast(ts as string) AS ts").collect()
    if want is None:
        assert got == []
    else:
        assert tuple(got[0])[:6] == want
        assert (got[0].hostname, got[0].ts) == ("web1", "2024-06-15 02:30:01")


def test_auth_headers_and_times(spark):
    got = authlog.parse(h.lines(spark, [
        "2024-06-15T02:30:01.123456+02:00 web1 sshd[1]: error: x",
        "2024-06-15T02:30:01 web1 sshd[1]: error: x",
        "Feb 30 02:30:01 web1 sshd[1]: error: x",
        "Foo 3 02:30:01 web1 sshd[1]: error: x",
        "Jan  3 02:30:61 web1 sshd[1]: error: x",
        "just an ERROR",
        "   ",
        "nothing to see",
    ]), year=2023).orderBy("seq").selectExpr("seq", "cast(ts as string) AS ts", "ts_ok", "hostname", "message").collect()
    assert [tuple(r)[:4] for r in got] == [
        (0, "2024-06-15 00:30:01.123456", True, "web1"), (1, "2024-06-15 02:30:01", True, "web1"),
        (2, None, False, "web1"), (3, "2023-01-03 02:30:01", True, "web1"), (4, None, False, "web1"),
        (5, None, False, "unknown")]
    assert got[5].message == "just an ERROR"


def test_invalid_user_lines_can_be_left_out(spark):
    df = h.lines(spark, [HEAD + "sshd[1]: Invalid user bob from 10.1.2.3 port 22",
                         HEAD + "sshd[1]: Failed password for invalid user bob from 10.1.2.3 port 22 ssh2"])
    assert authlog.parse(df).count() == 2
    assert authlog.parse(df, count_invalid_user=False).count() == 1


def parse_json(spark, *records, **options):
    return jsonlog.parse(h.lines(spark, [r if isinstance(r, str) else json.dumps(r) for r in records]), **options).orderBy("seq").collect()


def test_json_candidate_keys(spark):
    got = parse_json(
        spark,
        {"user": {"name": "a"}, "username": "b", "source": {"ip": "1.1.1.1"}, "client_ip": "2.2.2.2"},
        {"user": "plain", "source": "3.3.3.3"},
        {"user": {"id": 7}, "principalId": "p", "source": {"port": 1}, "remote_addr": "4.4.4.4"},
        {"username": None, "actor": {"login": "al"}, "host": ""},
        {"initiatedBy": {"user": {"userPrincipalName": "upn"}}, "device": 5},
        {"username": ["x"], "computer": {"a": 1}},
    )
    assert [r.username for r in got] == ["a", "plain", "p", "al", "upn", None]
    assert [r.source_ip for r in got] == ["1.1.1.1", "3.3.3.3", "4.4.4.4", None, None, None]
    assert [r.hostname for r in got] == ["unknown"] * 4 + ["5", "unknown"]


def test_json_times(spark):
    got = parse_json(
        spark, {"time": 1704067200}, {"time": 1704067200123}, {"time": 1704067200.5}, {"@timestamp": "2024-01-01T00:00:00Z"},
        {"date": "2024-01-01T02:00:00+02:00"}, {"date": "soon"}, {"date": "2024"}, {"time": True}, {}, {"@timestamp": "bad", "time": 5})
    base = datetime(2024, 1, 1)
    assert [r.ts and r.ts.replace(microsecond=0) for r in got] == [base] * 5 + [None] * 5
    assert [r.ts.microsecond for r in got[:3]] == [0, 123000, 500000]
    assert [r.ts_ok for r in got] == [True] * 5 + [False] * 5


def test_json_typed_fields(spark):
    got = parse_json(
        spark,
        {"event": {"id": 4624}, "event_id": 1, "process": {"name": "p", "command_line": "c"}, "destination": {"ip": "d"}},
        {"event": {"id": 0}, "event_id": 4625, "process": "q", "command_line": "r", "dest_ip": "e"},
        {"id": "12", "process": {"pid": 1}, "command_line": 5, "dest_ip": ["x"]},
    )
    assert [(r.event_id, r.process_name, r.command_line, r.dest_ip) for r in got] == [
        (4624, "p", "c", "d"), (4625, "q", "q", "e"), (None, None, None, None)]


def test_json_category_status_tags_message(spark):
    got = parse_json(
        spark,
        {"category": "zzz", "event": {"category": ["q", 1, "FileOpen"], "outcome": "maybe"}, "status": "Denied", "tags": ["a", 1]},
        {"action": "user-login", "success": True, "tags": {"k": "v"}, "message": "m" * 700},
        {"type": "audit of process", "result": "ok", "labels": ["l"], "log": 5},
        {"event": "network", "status": 200, "success": False},
    )
    assert [r.category for r in got] == ["file", "authentication", "process", "network"]
    assert [r.status for r in got] == ["failure", "success", "success", "failure"]
    assert [r.tags for r in got] == [["a", "1"], ["k:v"], ["l"], []]
    assert [len(r.message) for r in got[1:3]] == [500, 1]
    assert got[3].message.startswith('{"event":"network"')


def test_json_skips_what_is_no_record_and_filters_relevance(spark):
    texts = ['{"a": "Login"}', "[1]", "3", "{bad", "null", '{"a": "quiet"}', '{"a": 1} login', '{"a": 1}, {"a": 2}', ""]
    assert len(parse_json(spark, *texts)) == 2
    assert len(parse_json(spark, *texts, security_only=True)) == 1


NS = 'xmlns="http://schemas.microsoft.com/win/2004/08/events/event"'


def xml(eid, data="", system=""):
    return (f"<Event {NS}><System><EventID>{eid}</EventID><TimeCreated SystemTime='2024-01-01T00:00:00.1234567Z'/>"
            f"<Computer>WS1</Computer><Channel>Security</Channel>{system}</System><EventData>{data}</EventData></Event>")


def d(**fields):
    return "".join(f'<Data Name="{k}">{v}</Data>' for k, v in fields.items())


def test_windows_events(spark):
    got = winxml.parse(h.lines(spark, [
        xml(4624, d(SubjectUserName="s", IpAddress="-", LogonType="3")),
        xml(4625, d(TargetUserName="t", WorkstationName="w") + "<Data>loose</Data>"),
        xml(4688, d(SubjectUserName="s", NewProcessName="C:\\a.exe", NewProcessId="0x1F4")),
        xml(4732, d(MemberName="m", GroupName="g")),
        xml(1102), xml(7045, d(ServiceName="x", ImagePath="y")), xml("abc"), "<Event><Other/></Event>", "no xml",
        xml(4698, d(TaskName="a") + d(TaskName="b", SubjectUserName="s")),
    ])).orderBy("seq").collect()
    assert [r.event_id for r in got] == [4624, 4625, 4688, 4732, 1102, 7045, 0, 4698]
    assert [r.username for r in got] == ["s", "t", "s", "m", None, None, None, "s"]
    assert [r.source_ip for r in got[:2]] == [None, "w"]
    assert [r.logon_type for r in got[:3]] == [3, 0, None]
    assert got[2].process_id == 500 and got[2].parent_process == "" and got[2].command_line == ""
    assert [r.status for r in got] == ["success", "failure", None, "success", "cleared", None, None, None]
    assert [r.tags for r in got] == [[], [], [], ["privilege_escalation"], ["defense_evasion"], ["persistence"], [], ["persistence"]]
    assert got[3].message == "Privilege assigned to m: g"
    assert got[7].raw["TaskName"] == "b" and got[7].message == "Scheduled task created: b by s"
    assert got[0].ts == datetime(2024, 1, 1, 0, 0, 0, 123456) and got[0].channel == "Security"


@pytest.mark.parametrize("name, kind", [
    ("Security.EVTX", "winxml"), ("export.xml", "winxml"), ("auth.json", "authlog"), ("secure", "authlog"), ("x.log", "authlog"),
    ("a.json", "json"), ("a.JSONL", "json"), ("messages.1", "authlog")])
def test_routing(spark, name, kind):
    assert spark.range(1).select(ln.log_type(F.lit(name))).first()[0] == kind


def test_read_logs_from_files(spark, tmp_path):
    (tmp_path / "auth.log").write_text("\n".join([HEAD + f"sshd[1]: Failed password for u{i} from 10.0.0.1 port 1 ssh2" for i in range(50)]) + "\n\n")
    (tmp_path / "a.jsonl").write_text('{"username": "j1", "type": "login"}\n{broken\n{"username": "j2"}\n')
    (tmp_path / "lines.json").write_text('{"username": "j3"}\n{"username": "j4"}\nnope\n')
    (tmp_path / "array.json").write_text('[{"username": "j5"},\n {"username": "j6"}, 7]')
    (tmp_path / "wrapped.json").write_text('{"Records": [{"username": "j7"}, "x"]}')
    (tmp_path / "pretty.json").write_text('{\n  "username": "j8"\n}\n')
    (tmp_path / "win.xml").write_text(xml(4624, d(TargetUserName="w1")) + "\n<broken\n")
    (tmp_path / "torn.json").write_text('[{"username": "lost"\n, "x": {')
    got = ln.read_logs(spark, str(tmp_path)).cache()
    by_type = {r.source_type: r.n for r in got.groupBy("source_type").agg(F.count("*").alias("n")).collect()}
    assert by_type == {"authlog": 50, "json": 8, "evtx": 1}
    assert {r.username for r in got.filter("source_type = 'json'").collect()} == {f"j{i}" for i in range(1, 9)}
    assert got.select("seq").distinct().count() == 59
    users = [r.username for r in got.filter("source_type = 'authlog'").orderBy("seq").collect()]
    assert users == [f"u{i}" for i in range(50)]
    rejected = {r.path.split("/")[-1]: (r.records, r.rejected, r.lost) for r in ln.file_rejects(spark, str(tmp_path)).collect()}
    assert rejected == {
        "auth.log": (50, 0, False), "a.jsonl": (3, 1, False), "lines.json": (3, 1, False), "array.json": (3, 1, False),
        "wrapped.json": (2, 1, False), "pretty.json": (1, 0, False), "win.xml": (2, 1, False), "torn.json": (0, 0, True)}


def test_each_reader_opens_its_own_files(spark, tmp_path):
    for name in ("auth.log", "a.jsonl", "b.json", "c.xml"):
        (tmp_path / name).write_text("{}\n")
    files = ln.list_files(spark, str(tmp_path))
    assert {(p.split("/")[-1], k) for p, k, _ in files} == {("auth.log", "authlog"), ("a.jsonl", "json"), ("b.json", "json"), ("c.xml", "winxml")}
    for kind in ("authlog", "json", "winxml"):
        mine = [p for p, k, _ in files if k == kind]
        read = winxml.read(spark, mine) if kind == "winxml" else ln._text(spark, mine)
        assert {f.split("/")[-1] for f in read.inputFiles()} == {p.split("/")[-1] for p in mine}


def test_large_documents_lose_nothing(spark, tmp_path):
    records = [{"username": f"u{i}", "message": "m" * 2000} for i in range(40_000)]  # 80 MB
    (tmp_path / "rows.json").write_text("[" + ",\n".join(map(json.dumps, records)) + "]")
    (tmp_path / "one.json").write_text(json.dumps(records[:2000]))
    (tmp_path / "pretty.json").write_text(json.dumps({"events": records[:500]}, indent=1))
    got = ln.read_logs(spark, str(tmp_path)).groupBy(F.element_at(F.split("source_file", "/"), -1).alias("f")).agg(
        F.count("*").alias("n"), F.countDistinct("username").alias("u"))
    assert {r.f: (r.n, r.u) for r in got.collect()} == {"rows.json": (40_000, 40_000), "one.json": (2000, 2000), "pretty.json": (500, 500)}


def test_xml_events_over_lines_and_under_a_root(spark, tmp_path):
    (tmp_path / "e.xml").write_text('<?xml version="1.0"?>\n<Events>\n' + "\n".join(
        xml(4624, d(TargetUserName=f"w{i}")).replace("><", ">\n  <") for i in range(20)) + "\n<Event><Other/></Event></Events>")
    got = ln.read_logs(spark, str(tmp_path))
    assert {r.username for r in got.collect()} == {f"w{i}" for i in range(20)}
    assert [(r.records, r.rejected) for r in ln.file_rejects(spark, str(tmp_path)).collect()] == [(21, 1)]


def test_stage_folders(spark, tmp_path, monkeypatch):
    import os

    from nightwarden import session

    monkeypatch.setattr(session, "shared_dir", lambda s: str(tmp_path))
    with session.stages(spark):
        assert session.cut_lineage(spark.range(5)).count() == 5 and len(os.listdir(tmp_path)) == 1
    assert os.listdir(tmp_path) == []
    monkeypatch.undo()

    class Cluster:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError):
        session.shared_dir(Cluster)
