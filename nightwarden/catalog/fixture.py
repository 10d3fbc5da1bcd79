"""The driver's events table seen as normalized security events, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import event_columns, event_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_events(rows: DataFrame) -> DataFrame:
    """Map the driver's events to the event schema (whole table, one row each)."""
    e = rows.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    kind, k, user = F.col("event_type"), F.col("k"), F.col("user_id")

    def by_kind(**values):
        out = None
        for name, value in values.items():
            value = value if not isinstance(value, (str, int)) else F.lit(value)
            out = F.when(kind == name, value) if out is None else out.when(kind == name, value)
        return out

    ip = F.concat(F.when(user % 2 == 0, "10.0.0.").otherwise("8.8.4."), (user % 20).cast("string"))
    name = F.concat(F.lit("user"), user.cast("string"))
    sudo = (kind == "purchase") & (k % 3 == 0)
    return e.select(*event_columns(
        seq=F.col("event_id"),
        id=event_key(F.lit("events"), F.col("event_id")),
        source_type=F.lit("fixture"),
        source_file=F.lit("events"),
        hostname=F.when(k == 99, "unknown").otherwise(F.concat(F.lit("host"), (k % 8).cast("string"))),
        ts=F.col("ts").cast("timestamp"),
        ts_ok=F.lit(True),
        event_id=by_kind(error=4625, signup=4624, click=4688, purchase=4672),
        channel=F.when(kind != "view", "Security"),
        category=by_kind(error="authentication", signup="authentication", click="process", view="network",
                         purchase="system"),
        username=name,
        source_ip=ip,
        process_name=F.when(kind == "click", F.element_at(F.array(*map(F.lit, [
            "C:\\Windows\\System32\\cmd.exe", "C:\\Windows\\certutil.exe", "/bin/bash", "notepad.exe"])),
            k % 4 + 1)),
        command_line=F.when(sudo & (k % 2 == 0), "/usr/bin/passwd root").when(sudo, "/bin/ls -l"),
        logon_type=F.when(kind == "error", 3).when((kind == "signup") & (k % 2 == 0), 10).when(kind == "signup", 2),
        status=by_kind(error="failure", signup="success"),
        message=F.concat(
            by_kind(error="Failed password for ", signup="Accepted password for ", click="Process started by ",
                    view="Page viewed by ", purchase="Order placed by "), name, F.lit(" from "), ip),
        raw=F.create_map(F.lit("TaskName"), F.concat(F.lit("\\Task\\"), k.cast("string")), F.lit("ServiceName"),
                         F.when(k % 10 == 0, "PSEXESVC").otherwise("svc")),
        tags=F.when(kind == "error", F.array(F.lit("ssh_failed")))
        .when(kind == "signup", F.array(F.lit("ssh_success")))
        .when(sudo, F.array(F.lit("sudo")))
        .otherwise(F.array().cast("array<string>")),
    ))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


# The same mapping for the SQL side: a chain of common table expressions ending in ev.
EV = r"""
e0 AS (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k FROM events),
ev AS (
  SELECT event_id AS seq, ts, epoch_us(ts) AS us, k, user_id, event_type AS kind,
    CASE WHEN k = 99 THEN 'unknown' ELSE 'host' || (k % 8) END AS hostname,
    CASE event_type WHEN 'error' THEN 4625 WHEN 'signup' THEN 4624 WHEN 'click' THEN 4688
         WHEN 'purchase' THEN 4672 END AS event_id,
    CASE WHEN event_type <> 'view' THEN 'Security' END AS channel,
    CASE event_type WHEN 'error' THEN 'authentication' WHEN 'signup' THEN 'authentication' WHEN 'click' THEN 'process'
         WHEN 'view' THEN 'network' WHEN 'purchase' THEN 'system' END AS category,
    'user' || user_id AS username,
    CASE WHEN user_id % 2 = 0 THEN '10.0.0.' ELSE '8.8.4.' END || (user_id % 20) AS source_ip,
    CASE WHEN event_type = 'click' THEN CASE k % 4 WHEN 0 THEN 'C:\Windows\System32\cmd.exe'
         WHEN 1 THEN 'C:\Windows\certutil.exe' WHEN 2 THEN '/bin/bash' ELSE 'notepad.exe' END END AS process_name,
    CASE WHEN event_type = 'purchase' AND k % 6 = 0 THEN '/usr/bin/passwd root'
         WHEN event_type = 'purchase' AND k % 3 = 0 THEN '/bin/ls -l' END AS command_line,
    CASE WHEN event_type = 'error' THEN 3 WHEN event_type = 'signup' AND k % 2 = 0 THEN 10
         WHEN event_type = 'signup' THEN 2 END AS logon_type,
    CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'success' END AS status,
    CASE event_type WHEN 'error' THEN 'Failed password for ' WHEN 'signup' THEN 'Accepted password for '
         WHEN 'click' THEN 'Process started by ' WHEN 'view' THEN 'Page viewed by ' ELSE 'Order placed by ' END
      || 'user' || user_id || ' from ' || CASE WHEN user_id % 2 = 0 THEN '10.0.0.' ELSE '8.8.4.' END
      || (user_id % 20) AS message,
    '\Task\' || k AS task_name,
    CASE WHEN k % 10 = 0 THEN 'PSEXESVC' ELSE 'svc' END AS service_name,
    CASE WHEN event_type = 'error' THEN ['ssh_failed'] WHEN event_type = 'signup' THEN ['ssh_success']
         WHEN event_type = 'purchase' AND k % 3 = 0 THEN ['sudo'] ELSE [] END AS tags
  FROM e0
)"""


def with_ev(*more: str, select: str) -> str:
    """SQL over ev: further CTEs, then the final select."""
    return "WITH RECURSIVE " + ",\n".join([EV, *more]) + "\n" + select


DAY_US = 86_400_000_000
