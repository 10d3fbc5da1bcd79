"""Queries over the parsers (A*): log text is derived from the events table, then read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import authlog, jsonlog, lines as ln, winxml
from .fixture import table
from .registry import query


def _base(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("u"),
        F.concat(F.lit("10.1.2."), (F.col("user_id") % 200).cast("string")).alias("ip"),
        F.concat(F.lit("web"), (F.col("user_id") % 7).cast("string")).alias("host"),
        F.lit("events").alias("source_file"))


B = """b AS (SELECT event_id AS seq, ts, user_id, event_type, CAST(props->>'$.k' AS INTEGER) AS k, 'user' || user_id AS u,
  '10.1.2.' || (user_id % 200) AS ip, 'web' || (user_id % 7) AS host FROM events)"""


def _text(*parts) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _choose(number: Column, options: list[Column]) -> Column:
    out = F.when(number == 0, options[0])
    for i, option in enumerate(options[1:], 1):
        out = out.when(number == i, option)
    return out


# ---- auth logs -------------------------------------------------------------------------------------------------

def _bodies() -> Column:
    u, ip, k = F.col("u"), F.col("ip"), F.col("k")
    su = F.when(F.col("user_id") % 2 == 0, "Successful").otherwise("Failed")
    return _choose(k % 10, [
        _text("sshd[12]: Failed password for invalid user ", u, " from ", ip, " port 22 ssh2"),
        _text("sshd[12]: Accepted publickey for ", u, " from ", ip, " port 22 ssh2"),
        _text("sshd[12]: Invalid user ", u, " from 2001:db8::", k, " port 22"),
        _text("sudo: ", u, " : TTY=pts/0 ; PWD=/tmp ; USER=root ; COMMAND=/bin/cat /etc/", u),
        _text("su[9]: ", su, " su for root by ", u),
        _text("sshd[1]: pam_unix(sshd:auth): authentication failure; logname= uid=0 euid=0 tty=ssh ruser= rhost=", ip,
              "  user=", u),
        _text("useradd[7]: new user: name=", u, ", UID=1001, GID=1001, home=/home/", u),
        _text("CRON[5]: (root) CMD (/usr/bin/backup --level ", k, ")"),
        _text("systemd-logind[2]: Session Opened for ", u),
        _text("systemd[1]: Started daily cleanup ", k),
    ])


AUTH_TRUTH = """
t AS (SELECT *,
  CASE k % 10 WHEN 0 THEN 'ssh_failed' WHEN 1 THEN 'ssh_success' WHEN 2 THEN 'ssh_invalid_user' WHEN 3 THEN 'sudo'
    WHEN 4 THEN 'su' WHEN 5 THEN 'pam_failure' WHEN 6 THEN 'user_created' WHEN 7 THEN 'cron' ELSE '' END AS tag,
  CASE WHEN k % 10 IN (3, 7) THEN 'process' WHEN k % 10 IN (6, 8) THEN 'system' ELSE 'authentication' END AS category,
  CASE WHEN k % 10 IN (0, 2, 5) OR (k % 10 = 4 AND user_id % 2 = 1) THEN 'failure' WHEN k % 10 = 8 THEN NULL
    ELSE 'success' END AS status,
  CASE WHEN k % 10 IN (4, 7) THEN 'root' WHEN k % 10 = 8 THEN NULL ELSE u END AS username,
  CASE WHEN k % 10 IN (0, 1, 5) THEN ip WHEN k % 10 = 2 THEN '2001:db8::' || k END AS source_ip,
  CASE k % 10 WHEN 3 THEN '/bin/cat /etc/' || u WHEN 7 THEN '/usr/bin/backup --level ' || k END AS command_line,
  CASE k % 10 WHEN 3 THEN '/bin/cat' WHEN 7 THEN '/usr/bin/backup' END AS process_name
  FROM b WHERE k % 10 < 9)"""


def _auth_columns(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "seq", "hostname", F.col("ts").cast("timestamp_ntz").alias("ts"), "ts_ok", "category", "status", "username",
        "source_ip", "command_line", "process_name", F.array_join("tags", ",").alias("tag"))


def _syslog(spark, sf_dir) -> DataFrame:
    return _base(spark, sf_dir).withColumn("value", _text(
        "  ", F.date_format("ts", "MMM d HH:mm:ss"), " ", F.col("host"), " ", _bodies(), " "))


@query("authlog_parse", f"""WITH {B}, {AUTH_TRUTH}
SELECT seq, host AS hostname, date_trunc('second', ts) AS ts, true AS ts_ok, category, status, username, source_ip,
  command_line, process_name, tag FROM t""")
def authlog_parse(spark, sf_dir):
    """A2, A2a, A2c-A2f: syslog lines of all message kinds."""
    return _auth_columns(authlog.parse(_syslog(spark, sf_dir), year=2024))


@query("authlog_iso_parse", f"""WITH {B}, {AUTH_TRUTH}
SELECT seq, host AS hostname, CASE WHEN user_id % 4 = 1 THEN ts - INTERVAL 2 HOUR WHEN user_id % 4 < 3 THEN ts END AS ts,
  user_id % 4 < 3 AS ts_ok, category, status, username, source_ip, command_line, process_name, tag FROM t""")
def authlog_iso_parse(spark, sf_dir):
    """ISO 8601 headers with Z, an offset, no zone, and an unreadable one."""
    zone = _choose(F.col("user_id") % 4, [F.lit("Z"), F.lit("+02:00"), F.lit(""), F.lit("+99:99x")])
    lines = _base(spark, sf_dir).withColumn("value", _text(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), zone, " ", F.col("host"), " ", _bodies()))
    return _auth_columns(authlog.parse(lines))


@query("authlog_event_mix", f"""WITH {B}, {AUTH_TRUTH},
u2 AS (SELECT category, tag, coalesce(status, '') AS status, host AS hostname FROM t
       UNION ALL SELECT 'system', '', '', 'unknown' FROM b WHERE user_id % 3 = 0)
SELECT category, tag, status, hostname, count(*) AS n FROM u2 GROUP BY ALL""")
def authlog_event_mix(spark, sf_dir):
    """A2d-A2f: lines kept per kind and host, with header-less lines and blank ones among them."""
    lines = _syslog(spark, sf_dir)
    odd = lines.filter("user_id % 3 = 0").withColumn("value", _text("Access DENIED to ", F.col("u")))
    blank = lines.withColumn("value", F.lit("   "))
    return (
        authlog.parse(lines.unionByName(odd).unionByName(blank))
        .groupBy("category", F.array_join("tags", ",").alias("tag"), F.coalesce("status", F.lit("")).alias("status"), "hostname")
        .agg(F.count("*").alias("n")))


# ---- JSON ------------------------------------------------------------------------------------------------------

def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _iso() -> Column:
    return _text(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "Z")


def _json_layouts() -> Column:
    u, ip, host, k = F.col("u"), F.col("ip"), F.col("host"), F.col("k")
    outcome = F.when(F.col("user_id") % 2 == 0, "success").otherwise("Failure")
    ecs = _json(**{
        "@timestamp": _iso(), "user": F.struct(u.alias("name"), k.alias("nr")), "source": F.struct(ip.alias("ip")),
        "host": F.struct(host.alias("name")), "tags": F.array(F.lit("t"), u),
        "event": F.struct(F.array(F.lit("x"), F.lit("Authentication")).alias("category"), outcome.alias("outcome"), k.alias("id")),
        "process": F.struct(F.lit("bash").alias("name"), _text("bash -c ", k).alias("command_line")),
        "message": _text("login of ", u)})
    flat = _json(timestamp=F.unix_seconds("ts"), username=u, client_ip=ip, hostname=host, type=F.lit("network-connection"),
                 status=F.lit("OK"), event_id=F.lit(4625), msg=_text("flow ", k))
    cloud = _json(eventTime=F.unix_millis("ts"), user=u, sourceIPAddress=ip, eventName=F.lit("ConsoleLogin"),
                  result=F.lit("denied"), action=F.lit("login"), dest_ip=F.lit("10.9.9.9"), id=F.lit("12"), device=host)
    odd = _json(date=F.lit("not a time"), user=F.struct(k.alias("x")), principalId=u, success=F.lit(False),
                labels=F.struct(u.alias("a")), description=F.repeat(F.lit("long text "), 60))
    return _choose(k % 4, [ecs, flat, cloud, odd])


@query("json_normalize", f"""WITH {B}
SELECT seq,
  CASE k % 4 WHEN 0 THEN ts WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('millisecond', ts) END AS ts,
  k % 4 < 3 AS ts_ok, u AS username, CASE WHEN k % 4 < 3 THEN ip END AS source_ip,
  CASE WHEN k % 4 < 3 THEN host ELSE 'unknown' END AS hostname,
  CASE k % 4 WHEN 0 THEN 'authentication' WHEN 1 THEN 'network' WHEN 2 THEN 'authentication' ELSE 'unknown' END AS category,
  CASE k % 4 WHEN 0 THEN CASE WHEN user_id % 2 = 0 THEN 'success' ELSE 'failure' END WHEN 1 THEN 'success' ELSE 'failure' END AS status,
  CASE WHEN k % 4 = 0 AND k > 0 THEN k WHEN k % 4 = 1 THEN 4625 END AS event_id,
  CASE k % 4 WHEN 0 THEN 'bash' END AS process_name, CASE k % 4 WHEN 0 THEN 'bash -c ' || k END AS command_line,
  CASE k % 4 WHEN 2 THEN '10.9.9.9' END AS dest_ip,
  CASE k % 4 WHEN 0 THEN 'login of ' || u WHEN 1 THEN 'flow ' || k WHEN 2 THEN 'ConsoleLogin'
    ELSE substr(repeat('long text ', 60), 1, 500) END AS message,
  CASE k % 4 WHEN 0 THEN 't,' || u WHEN 3 THEN 'a:' || u ELSE '' END AS tags FROM b""")
def json_normalize(spark, sf_dir):
    """A3, A3a-A3g: four record layouts, read back from their JSON text."""
    lines = _base(spark, sf_dir).withColumn("value", _json_layouts())
    noise = lines.withColumn("value", F.when(F.col("k") % 2 == 0, "[1, 2]").otherwise("{broken"))
    return jsonlog.parse(lines.unionByName(noise)).select(
        "seq", F.col("ts").cast("timestamp_ntz").alias("ts"), "ts_ok", "username", "source_ip", "hostname", "category",
        "status", "event_id", "process_name", "command_line", "dest_ip", "message", F.array_join("tags", ",").alias("tags"))


@query("json_epoch_times", f"""WITH {B}
SELECT seq, CASE k % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('millisecond', ts) WHEN 2 THEN ts
  WHEN 3 THEN ts WHEN 4 THEN date_trunc('day', ts) END AS ts, k % 6 < 5 AS ts_ok FROM b""")
def json_epoch_times(spark, sf_dir):
    """Seconds, milliseconds, ISO with and without zone, a date, and text that is no time."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    value = _choose(F.col("k") % 6, [
        _json(time=F.unix_seconds("ts")), _json(time=F.unix_millis("ts")), _json(time=_iso()), _json(datetime=text),
        _json(date=F.date_format("ts", "yyyy-MM-dd")), _json(created_at=F.lit("1704067200 or so"))])
    return jsonlog.parse(_base(spark, sf_dir).withColumn("value", value)).select(
        "seq", F.col("ts").cast("timestamp_ntz").alias("ts"), "ts_ok")


CATEGORY_TEXTS = ["User-Login", "PROCESS_START", "netflow connection", "FileDelete", "registry set", "Operating System",
                  "audit trail", "nothing", "AuthN", "logon audit"]
STATUS_TEXTS = ["SUCCESS", "succeeded", "Ok", "200", "failure", "FAILED", "error", "Denied", "unauthorized", "pending"]


@query("json_category_status", f"""WITH {B},
c AS (SELECT *, {CATEGORY_TEXTS!r}[k % 10 + 1] AS ct, {STATUS_TEXTS!r}[user_id % 10 + 1] AS st FROM b),
d AS (SELECT CASE k % 10 WHEN 0 THEN 'authentication' WHEN 1 THEN 'process' WHEN 2 THEN 'network' WHEN 3 THEN 'file'
    WHEN 4 THEN 'registry' WHEN 5 THEN 'system' WHEN 6 THEN 'audit' WHEN 7 THEN 'unknown' ELSE 'authentication' END AS category,
  CASE WHEN user_id % 10 < 4 THEN 'success' WHEN user_id % 10 < 9 THEN 'failure'
    WHEN k % 2 = 0 THEN 'success' ELSE 'failure' END AS status FROM c)
SELECT category, status, count(*) AS n FROM d GROUP BY ALL""")
def json_category_status(spark, sf_dir):
    """A3d, A3e: category words in texts and lists under several keys; outcome words, then booleans."""
    k, user = F.col("k"), F.col("user_id")
    category = F.element_at(F.array(*map(F.lit, CATEGORY_TEXTS)), k % 10 + 1)
    status = F.element_at(F.array(*map(F.lit, STATUS_TEXTS)), (user % 10 + 1).cast("int"))
    flag = k % 2 == 0
    value = _choose(user % 3, [
        _json(category=category, outcome=status, success=flag),
        _json(category=F.lit("none"), action=F.array(F.lit("-"), category), status=status, success=flag),
        _json(event=F.struct(category.alias("category"), status.alias("outcome")), result=F.lit("?"), success=flag)])
    return (
        jsonlog.parse(_base(spark, sf_dir).withColumn("value", value))
        .groupBy("category", "status").agg(F.count("*").alias("n")))


@query("json_tags", f"""WITH {B}
SELECT seq, CASE k % 5 WHEN 0 THEN u || ',7' WHEN 1 THEN 'env:prod,who:' || u WHEN 2 THEN 'l1,' || u ELSE '' END AS tags FROM b""")
def json_tags(spark, sf_dir):
    """A3g: tag lists, tag objects, the fallback key, a bare text and nothing."""
    u = F.col("u")
    value = _choose(F.col("k") % 5, [
        F.concat(F.lit('{"tags":["'), u, F.lit('",7]}')),
        _json(tags=F.struct(F.lit("prod").alias("env"), u.alias("who"))),
        F.concat(F.lit('{"tags":[],"labels":["l1","'), u, F.lit('"]}')),
        _json(tags=u), _json(other=u)])
    return jsonlog.parse(_base(spark, sf_dir).withColumn("value", value)).select(
        "seq", F.array_join("tags", ",").alias("tags"))


WORDS = (  # stated here so that the SQL does not depend on what it checks
    "auth|login|logon|fail|error|deny|block|attack|malware|suspicious|anomal|threat|exploit|privilege|escalat|lateral|exfil|"
    "command|execution")


@query("json_relevance_filter", f"""
WITH l AS (SELECT 'events' AS source, '{{"type":"' || event_type || '","props":' || props || '}}' AS line, event_id AS key FROM events
  UNION ALL SELECT 'documents', text, doc_id FROM documents UNION ALL SELECT 'conversations', text, conv_id FROM conversations)
SELECT source, count(*) AS lines, count(*) FILTER (regexp_matches(lower(line), '{WORDS}')) AS relevant,
  coalesce(sum(key) FILTER (regexp_matches(lower(line), '{WORDS}')), 0) AS key_sum FROM l GROUP BY source""")
def json_relevance_filter(spark, sf_dir):
    """A3h: security relevance of whole texts."""
    e = table(spark, sf_dir, "events")
    lines = e.select(
        F.lit("events").alias("source"),
        _text('{"type":"', F.col("event_type"), '","props":', F.col("props"), "}").alias("line"), F.col("event_id").alias("key"))
    for name, key in (("documents", "doc_id"), ("conversations", "conv_id")):
        lines = lines.unionByName(table(spark, sf_dir, name).select(
            F.lit(name).alias("source"), F.col("text").alias("line"), F.col(key).alias("key")))
    hit = jsonlog.is_relevant(F.col("line"))
    return lines.groupBy("source").agg(
        F.count("*").alias("lines"), F.count_if(hit).alias("relevant"),
        F.coalesce(F.sum(F.when(hit, F.col("key"))), F.lit(0)).alias("key_sum"))


# ---- Windows XML -----------------------------------------------------------------------------------------------

def _data(**fields: Column) -> Column:
    parts = ["<EventData>"]
    for name, value in fields.items():
        parts += [f'<Data Name="{name}">', value, "</Data>"]
    return _text(*parts, "<Data>unnamed</Data></EventData>")


def _xml(eid, data: Column) -> Column:
    return _text(
        '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><EventID>', eid,
        '</EventID><TimeCreated SystemTime="', F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), '0Z"/><Computer>',
        F.col("host"), "</Computer><Channel>Security</Channel></System>", data, "</Event>")


def _xml_lines() -> Column:
    u, ip, k = F.col("u"), F.col("ip"), F.col("k")
    return _choose(k % 10, [
        _xml("4624", _data(TargetUserName=F.lit(""), SubjectUserName=u, IpAddress=F.lit("-"), LogonType=F.lit("10"))),
        _xml("4625", _data(TargetUserName=u, IpAddress=F.lit(""), WorkstationName=ip, LogonType=F.lit(""), FailureReason=F.lit("bad"))),
        _xml("4688", _data(SubjectUserName=u, NewProcessName=F.lit("C:\\cmd.exe"), ParentProcessName=F.lit("p.exe"),
                           CommandLine=_text("cmd /c ", k), NewProcessId=_text("0x", F.lower(F.hex(F.col("user_id")))))),
        _xml("4672", _data(SubjectUserName=u, PrivilegeList=F.lit("SeDebug"))),
        _xml("4720", _data(TargetUserName=u)),
        _xml("4698", _data(SubjectUserName=u, TaskName=F.lit("\\t"))),
        _xml("7045", _data(ServiceName=F.lit("svc"), ImagePath=F.lit("C:\\s.exe"))),
        _xml("1102", _data(SubjectUserName=u)),
        _xml("4776", _data(TargetUserName=F.lit("first"), TargetUserName2=F.lit("x"), IpAddress=ip)),
        _xml(F.lit("90") , _data(Other=u)),
    ])


XML_TRUTH = """
x AS (SELECT seq, host AS hostname, ts, [4624, 4625, 4688, 4672, 4720, 4698, 7045, 1102, 4776, 90][k % 10 + 1] AS event_id, 'Security' AS channel,
  ['authentication', 'authentication', 'process', 'authentication', 'system', 'system', 'system', 'audit', 'authentication', 'unknown'][k % 10 + 1] AS category,
  CASE WHEN k % 10 IN (6, 9) THEN NULL WHEN k % 10 = 8 THEN 'first' ELSE u END AS username,
  CASE WHEN k % 10 IN (1, 8) THEN ip END AS source_ip,
  CASE k % 10 WHEN 2 THEN 'C:\\cmd.exe' END AS process_name, CASE k % 10 WHEN 2 THEN user_id END AS process_id,
  CASE k % 10 WHEN 2 THEN 'p.exe' END AS parent_process, CASE k % 10 WHEN 2 THEN 'cmd /c ' || k END AS command_line,
  CASE k % 10 WHEN 0 THEN 10 WHEN 1 THEN 0 WHEN 8 THEN 0 END AS logon_type,
  CASE WHEN k % 10 IN (0, 3, 8) THEN 'success' WHEN k % 10 = 1 THEN 'failure' WHEN k % 10 = 7 THEN 'cleared' END AS status,
  CASE k % 10 WHEN 0 THEN 'Logon success: ' || u || ' from None (type 10)' WHEN 1 THEN 'Logon FAILED: ' || u || ' from ' || ip || ' — bad'
    WHEN 2 THEN 'Process created: C:\\cmd.exe by ' || u WHEN 3 THEN 'Privilege assigned to ' || u || ': SeDebug'
    WHEN 4 THEN 'Account action (EID 4720): ' || u WHEN 5 THEN 'Scheduled task created: \\t by ' || u
    WHEN 6 THEN 'Service installed: svc → C:\\s.exe' WHEN 7 THEN 'Audit log cleared by ' || u
    WHEN 8 THEN 'Logon success: first from ' || ip || ' (type 0)' ELSE 'Event 90 on ' || host END AS message,
  CASE k % 10 WHEN 3 THEN 'privilege_escalation' WHEN 5 THEN 'persistence' WHEN 6 THEN 'persistence' WHEN 7 THEN 'defense_evasion' ELSE '' END AS tags
  FROM b)"""


@query("winxml_normalize", f"WITH {B}, {XML_TRUTH} SELECT * FROM x")
def winxml_normalize(spark, sf_dir):
    """Event XML of every id class."""
    lines = _base(spark, sf_dir).withColumn("value", _xml_lines())
    broken = lines.withColumn("value", F.lit("<Event><System>"))
    return winxml.parse(lines.unionByName(broken)).select(
        "seq", "hostname", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "channel", "category", "username",
        "source_ip", "process_name", "process_id", "parent_process", "command_line", "logon_type", "status", "message",
        F.array_join("tags", ",").alias("tags"))


# ---- routing ---------------------------------------------------------------------------------------------------

FILES = ["web-AUTH.json", "app.jsonl", "Security.xml", "syslog"]


def _mixed(spark, sf_dir) -> DataFrame:
    """Lines of four files; every eleventh user's lines are broken."""
    which = F.col("user_id") % 4
    good = _choose(which, [_text(F.date_format("ts", "MMM d HH:mm:ss"), " ", F.col("host"), " ", _bodies()),
                           _json_layouts(), _xml_lines(), _text("kernel: I/O error on sd", F.col("k"))])
    return (
        _base(spark, sf_dir)
        .withColumn("value", F.when(F.col("user_id") % 11 == 0, "{<broken").otherwise(good))
        .withColumn("file_name", _choose(which, [F.lit(f) for f in FILES]))
        .withColumn("source_file", F.concat(F.lit("/logs/"), F.col("file_name"))))


@query("source_union_counts", f"""WITH {B}, {AUTH_TRUTH}, {XML_TRUTH},
g AS (SELECT * FROM b WHERE user_id % 11 <> 0),
r AS (
  SELECT 'authlog' AS source_type, '{FILES[0]}' AS file_name, category, seq FROM t WHERE user_id % 11 <> 0 AND user_id % 4 = 0
  UNION ALL SELECT 'json', '{FILES[1]}', CASE k % 4 WHEN 0 THEN 'authentication' WHEN 1 THEN 'network' WHEN 2 THEN 'authentication' ELSE 'unknown' END, seq
    FROM g WHERE user_id % 4 = 1
  UNION ALL SELECT 'evtx', '{FILES[2]}', x.category, seq FROM x JOIN g USING (seq) WHERE user_id % 4 = 2
  UNION ALL SELECT 'authlog', '{FILES[3]}', 'system', seq FROM g WHERE user_id % 4 = 3)
SELECT source_type, file_name, category, count(*) AS n, sum(seq) AS seq_sum FROM r GROUP BY ALL""")
def source_union_counts(spark, sf_dir):
    """A1, A5: lines of several files routed to their parsers and put into one table."""
    return (
        ln.parse_lines(_mixed(spark, sf_dir))
        .groupBy("source_type", F.element_at(F.split("source_file", "/"), -1).alias("file_name"), "category")
        .agg(F.count("*").alias("n"), F.sum("seq").alias("seq_sum")))


@query("source_rejects", f"""WITH {B}
SELECT '/logs/' || {FILES!r}[user_id % 4 + 1] AS source_file, ['authlog', 'json', 'winxml', 'authlog'][user_id % 4 + 1] AS log_type,
  count(*) AS lines, count(*) FILTER (user_id % 11 = 0 AND user_id % 4 IN (1, 2)) AS rejected FROM b GROUP BY ALL""")
def source_rejects(spark, sf_dir):
    """Unreadable lines per file."""
    return ln.rejects(_mixed(spark, sf_dir))
