"""Windows event XML to events (A4): one event's XML text per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.predicates import holds
from ..schema import event_columns, event_key

XML_SCHEMA = (
    "System STRUCT<EventID: STRING, TimeCreated: STRUCT<_SystemTime: STRING>, Computer: STRING, Channel: STRING>, "
    "EventData STRUCT<Data: ARRAY<STRUCT<_Name: STRING, _VALUE: STRING>>>"
)

# Event ids by what they report; the message texts in parse are fixed values too.
LOGON_SUCCESS = [4624, 4648, 4768, 4769, 4776]
LOGON_FAILURE = [4625]
PROCESS_START = [4688]
PRIVILEGE = [4672, 4732]
ACCOUNT = [4720, 4726, 4738]
SCHEDULED_TASK = [4698, 4702]
SERVICE = [7045]
AUDIT = [1102, 1100]


def _parse(text: Column) -> Column:
    return F.from_xml(text, XML_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"})


def is_record(text: Column) -> Column:
    return holds(_parse(text)["System"].isNotNull())


def _last_wins(entries: Column) -> Column:
    """Name to value map of the named entries; of equal names the last one counts."""
    named = F.filter(entries, lambda e: holds(e["_Name"] != ""))
    names = F.transform(named, lambda e: e["_Name"])
    last = F.filter(named, lambda e, i: ~F.array_contains(F.slice(names, i + 2, F.size(names)), e["_Name"]))
    return F.map_from_entries(F.transform(
        last, lambda e: F.struct(e["_Name"].alias("key"), F.coalesce(e["_VALUE"], F.lit("")).alias("value"))))


def read(spark: SparkSession, files: list[str]) -> DataFrame:
    """All Event elements of XML files (columns x, value, source_file, seq), over one line or many, under any root.

    Large files are split between tasks. A damaged element has no System block.
    """
    kind = f"value string, source_file string, seq long, x struct<{XML_SCHEMA}>"
    if not files:
        return spark.createDataFrame([], kind)
    rows = spark.read.format("xml").option("rowTag", "Event").option("ignoreCorruptFiles", "true").schema(XML_SCHEMA).load(files)
    x = F.struct("System", "EventData")
    return rows.select(F.to_json(x).alias("value"), F.col("_metadata.file_path").alias("source_file"),
                       F.monotonically_increasing_id().alias("seq"), x.alias("x"))


def parse(lines: DataFrame, default_ts: Column | None = None) -> DataFrame:
    """Events of XML texts (columns value, source_file, seq); text without a System block is skipped."""
    # A generator instead of a filter, so that the text is parsed once.
    events = F.filter(F.array(_parse(F.col("value"))), lambda x: x["System"].isNotNull())
    return parse_elements(lines.select("seq", "source_file", "value", F.explode(events).alias("x")), default_ts)


def parse_elements(elements: DataFrame, default_ts: Column | None = None) -> DataFrame:
    """Events of parsed elements (columns x, value, source_file, seq); those without a System block are skipped."""
    rows = elements.filter("x.System IS NOT NULL").select(
        "seq", "source_file", "value",
        F.coalesce(F.col("x.System.EventID").try_cast("int"), F.lit(0)).alias("eid"),
        F.col("x.System.TimeCreated._SystemTime").try_cast("timestamp").alias("read_ts"),
        F.nullif("x.System.Computer", F.lit("")).alias("host"),
        F.nullif("x.System.Channel", F.lit("")).alias("channel"),
        F.coalesce(_last_wins(F.col("x.EventData.Data")), F.create_map().cast("map<string,string>")).alias("data"))

    eid = F.col("eid")
    is_logon, is_fail, is_process = eid.isin(LOGON_SUCCESS), eid.isin(LOGON_FAILURE), eid.isin(PROCESS_START)
    is_priv, is_account, is_task = eid.isin(PRIVILEGE), eid.isin(ACCOUNT), eid.isin(SCHEDULED_TASK)
    is_service, is_audit = eid.isin(SERVICE), eid.isin(AUDIT)

    def data(name: str) -> Column:
        return F.try_element_at("data", F.lit(name))

    def filled(*names: str) -> Column:
        """The first of the fields that is there and not empty; Windows writes '-' for no value."""
        return F.coalesce(*[F.nullif(data(n), F.lit("")) for n in names])

    def text(col: Column) -> Column:
        return F.coalesce(col.cast("string"), F.lit("None"))

    def or_empty(*cols: Column) -> Column:
        return F.coalesce(*cols, F.lit(""))

    subject, target = data("SubjectUserName"), data("TargetUserName")
    user = (
        F.when(is_logon, filled("TargetUserName", "SubjectUserName"))
        .when(is_fail | is_account, target)
        .when(is_process | is_task | is_audit, subject)
        .when(is_priv, filled("SubjectUserName", "MemberName")))
    address = F.when(is_logon | is_fail, F.nullif(filled("IpAddress", "WorkstationName"), F.lit("-")))
    logon_type = F.when(is_logon | is_fail, F.coalesce(data("LogonType").try_cast("int"), F.lit(0)))
    hex_pid = F.regexp_extract(F.coalesce(data("NewProcessId"), F.lit("0")), r"^(?:0[xX])?([0-9A-Fa-f]{1,15})$", 1)
    process = or_empty(data("NewProcessName"))
    message = (
        F.when(is_logon, F.concat(F.lit("Logon success: "), text(user), F.lit(" from "), text(address),
                                  F.lit(" (type "), text(logon_type), F.lit(")")))
        .when(is_fail, F.concat(F.lit("Logon FAILED: "), text(user), F.lit(" from "), text(address), F.lit(" — "),
                                or_empty(data("FailureReason"))))
        .when(is_process, F.concat(F.lit("Process created: "), process, F.lit(" by "), text(user)))
        .when(is_priv, F.concat(F.lit("Privilege assigned to "), text(user), F.lit(": "),
                                or_empty(data("PrivilegeList"), data("GroupName"))))
        .when(is_account, F.concat(F.lit("Account action (EID "), text(eid), F.lit("): "), text(user)))
        .when(is_task, F.concat(F.lit("Scheduled task created: "), or_empty(data("TaskName")), F.lit(" by "), text(user)))
        .when(is_service, F.concat(F.lit("Service installed: "), or_empty(data("ServiceName")), F.lit(" → "),
                                   or_empty(data("ImagePath"))))
        .when(is_audit, F.concat(F.lit("Audit log cleared by "), text(user)))
        .otherwise(F.concat(F.lit("Event "), text(eid), F.lit(" on "), F.coalesce("host", F.lit("unknown")))))
    tag = (
        F.when(is_priv, "privilege_escalation").when(is_task | is_service, "persistence")
        .when(is_audit, "defense_evasion"))
    return rows.select(*event_columns(
        seq=F.col("seq"),
        id=event_key(F.col("source_file"), F.col("seq"), F.col("value")),
        source_type=F.lit("evtx"),
        source_file=F.col("source_file"),
        hostname=F.col("host"),
        ts=F.col("read_ts") if default_ts is None else F.coalesce("read_ts", default_ts),
        ts_ok=F.col("read_ts").isNotNull(),
        event_id=eid,
        channel=F.col("channel"),
        category=F.when(is_logon | is_fail | is_priv, "authentication").when(is_process, "process")
        .when(is_account | is_task | is_service, "system").when(is_audit, "audit").otherwise("unknown"),
        username=user,
        source_ip=address,
        process_name=F.when(is_process, process),
        process_id=F.when(is_process, F.conv(F.nullif(hex_pid, F.lit("")), 16, 10).cast("long")),
        parent_process=F.when(is_process, or_empty(data("ParentProcessName"))),
        command_line=F.when(is_process, or_empty(data("CommandLine"))),
        logon_type=logon_type,
        status=F.when(is_logon | is_priv, "success").when(is_fail, "failure").when(is_audit, "cleared"),
        message=message,
        raw=F.col("data"),
        tags=F.array_compact(F.array(tag)),
    ))
