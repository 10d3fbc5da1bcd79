"""Auth-log lines to events (A2): header, timestamp, first matching pattern, keyword fallback."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import event_columns, event_key

# The two header formats. Groups: month, day, time, host, process, message; and time, host, process, message.
SYSLOG_HEADER = r"^(\w+)\s+(\d+)\s+(\d+:\d+:\d+)\s+(\S+)\s+([^:]+):\s*(.+)$"
ISO_HEADER = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\S*)\s+(\S+)\s+([^:]+):\s*(.+)$"
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


@dataclass(frozen=True)
class Pattern:
    """A message form; user, ip and cmd are group numbers in regex (0: not present); word is part of every match."""

    tag: str
    category: str
    status: str | None
    word: str
    regex: str
    user: int = 1
    ip: int = 0
    cmd: int = 0


# Message patterns in order of precedence. They see "process: message", as the daemons write it.
PATTERNS = [
    Pattern("ssh_failed", "authentication", "failure", "Failed password for ",
            r"Failed password for (?:invalid user )?(\S+) from ([0-9A-Fa-f:.]+)", ip=2),
    Pattern("ssh_success", "authentication", "success", "Accepted ",
            r"Accepted (?:password|publickey) for (\S+) from ([0-9A-Fa-f:.]+)", ip=2),
    Pattern("ssh_invalid_user", "authentication", "failure", "Invalid user ", r"Invalid user (\S+) from ([0-9A-Fa-f:.]+)", ip=2),
    Pattern("sudo", "process", "success", "COMMAND=", r"sudo(?:\[\d+\])?:\s+(\S+)\s+:.*COMMAND=(.+)$", cmd=2),
    Pattern("su", "authentication", None, " su for ", r"su\[.*\]: (?:Successful|Failed) su for (\S+)"),
    Pattern("pam_failure", "authentication", "failure", "pam_unix", r"pam_unix.*: authentication failure.*user=(\S+)"),
    Pattern("user_created", "system", "success", "useradd", r"useradd.*: new user: name=([^,\s]+)"),
    Pattern("cron", "process", "success", "CRON", r"CRON(?:\[\d+\])?: \((\S+)\) CMD \((.+)\)", cmd=2),
]
REMOTE_HOST = r"rhost=(\S+)"

# Words that keep a line no pattern knows.
SECURITY_WORDS = [
    "error", "fail", "invalid", "unauthorized", "denied", "attack", "blocked", "auth", "session opened", "session closed",
]

_GAP = "\u0001\u0002\u0001"


def _groups(text: Column, regex: str, n: int) -> Column:
    """All n groups of an anchored pattern in one pass; an array of another size when it does not match."""
    marked = F.regexp_replace(text, regex, _GAP.join(f"${i}" for i in range(1, n + 1)))
    return F.split(marked, _GAP, n)


def _syslog_time(parts: Column, year: int) -> Column:
    month = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, MONTHS)), parts[0]), F.lit(0)), F.lit(1))
    clock = F.split(parts[2], ":")
    second = clock[2].try_cast("int")
    return F.when(second < 60, F.try_make_timestamp(
        F.lit(year), month.cast("int"), parts[1].try_cast("int"), clock[0].try_cast("int"), clock[1].try_cast("int"),
        second.cast("decimal(16,6)")))


def _classify(text: Column, message: Column, skip: set[str]) -> Column:
    """The first matching pattern's reading of the line, in an array of one; an array keeps the CASE a plain generator
    input, so each pattern is tried once per line. NULL drops the line."""

    def reading(tag, category, status, user=None, ip=None, cmd=None) -> Column:
        parts = {"tag": tag, "category": category, "status": status, "user": user, "ip": ip, "cmd": cmd}
        return F.array(F.struct(*[
            (v if isinstance(v, Column) else F.lit(v)).cast("string").alias(name) for name, v in parts.items()]))

    out = F.when(F.lit(False), reading(None, None, None))
    for p in PATTERNS:
        if p.ip:
            ip = F.regexp_extract(text, p.regex, p.ip)
        else:
            ip = F.nullif(F.regexp_extract(text, REMOTE_HOST, 1), F.lit("")) if p.tag == "pam_failure" else None
        status = p.status or F.when(text.contains("Successful"), "success").otherwise("failure")
        cmd = F.regexp_extract(text, p.regex, p.cmd) if p.cmd else None
        found = reading(p.tag, p.category, status, F.regexp_extract(text, p.regex, p.user), ip, cmd)
        out = out.when(text.contains(p.word) & text.rlike(p.regex), F.lit(None) if p.tag in skip else found)
    return out.when(F.lower(message).rlike("|".join(SECURITY_WORDS)), reading(None, "system", None))


def parse(lines: DataFrame, year: int = 2024, default_ts: Column | None = None,
          count_invalid_user: bool = True) -> DataFrame:
    """Events of auth-log lines (columns value, source_file, seq).

    Lines without a header keep host unknown and the whole line as message. A time that cannot be read gives
    default_ts (NULL by default) and ts_ok false. sshd may report one attempt by an unknown user twice;
    count_invalid_user=False drops the "Invalid user" line.
    """
    split = lines.withColumn("line", F.regexp_replace("value", r"^\s+|\s+$", "")).filter("line <> ''").withColumn(
        "sys", _groups(F.col("line"), SYSLOG_HEADER, 6))
    split = split.withColumn("iso", F.when(F.size("sys") != 6, _groups(F.col("line"), ISO_HEADER, 4)))
    is_sys = F.size("sys") == 6
    is_iso = F.col("iso").isNotNull() & (F.size("iso") == 4)

    def headed(at_sys: Column, at_iso: Column, otherwise: Column) -> Column:
        return F.when(is_sys, at_sys).when(is_iso, at_iso).otherwise(otherwise)

    sys, iso, nothing = F.col("sys"), F.col("iso"), F.lit(None)
    message = headed(sys[5], iso[3], F.col("line"))
    head = F.struct(
        headed(sys[3], iso[1], nothing).alias("host"),
        headed(F.concat(sys[4], F.lit(": "), sys[5]), F.concat(iso[2], F.lit(": "), iso[3]), F.col("line")).alias("text"),
        message.alias("msg"),
        headed(_syslog_time(sys, year), iso[0].try_cast("timestamp"), nothing).alias("read_ts"))
    skip = set() if count_invalid_user else {"ssh_invalid_user"}
    kept = (
        split.select("seq", "source_file", "line", F.inline(F.array(head)))
        .select("*", F.explode(_classify(F.col("text"), F.col("msg"), skip)).alias("hit"))
    )
    return kept.select(*event_columns(
        seq=F.col("seq"),
        id=event_key(F.col("source_file"), F.col("seq"), F.col("line")),
        source_type=F.lit("authlog"),
        source_file=F.col("source_file"),
        hostname=F.col("host"),
        ts=F.col("read_ts") if default_ts is None else F.coalesce("read_ts", default_ts),
        ts_ok=F.col("read_ts").isNotNull(),
        category=F.col("hit.category"),
        username=F.col("hit.user"),
        source_ip=F.col("hit.ip"),
        process_name=F.nullif(F.split(F.ltrim("hit.cmd"), r"\s+")[0], F.lit("")),
        command_line=F.col("hit.cmd"),
        status=F.col("hit.status"),
        message=F.col("msg"),
        raw=F.create_map(F.lit("line"), F.col("line")),
        tags=F.array_compact(F.array("hit.tag")),
    ))
