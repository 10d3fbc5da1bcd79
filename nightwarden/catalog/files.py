"""Queries over log files: written from the events table to the stage folder, listed, routed and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import lines as ln
from ..sources import winxml
from .registry import query
from .sources import XML_TRUTH, B, _base, _json_layouts, _xml_lines

DOCUMENT_RECORDS = 1000

JSON_TRUTH = """
j AS (SELECT
  CASE k % 4 WHEN 0 THEN ts WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('millisecond', ts) END AS ts,
  u AS username, CASE WHEN k % 4 < 3 THEN ip END AS source_ip, CASE WHEN k % 4 < 3 THEN host ELSE 'unknown' END AS hostname,
  CASE k % 4 WHEN 0 THEN 'authentication' WHEN 1 THEN 'network' WHEN 2 THEN 'authentication' ELSE 'unknown' END AS category,
  CASE k % 4 WHEN 0 THEN CASE WHEN user_id % 2 = 0 THEN 'success' ELSE 'failure' END WHEN 1 THEN 'success' ELSE 'failure' END AS status
  FROM b)"""


def json_documents_folder(spark, sf_dir) -> str:
    """One document per DOCUMENT_RECORDS events: a list under Records, with one item that is no record."""
    path = scratch_path(spark, "json-documents")
    rows = _base(spark, sf_dir).select(F.floor(F.col("seq") / DOCUMENT_RECORDS).alias("part"), F.parse_json(_json_layouts()).alias("v"))
    lists = rows.groupBy("part").agg(F.collect_list("v").alias("Records"))
    lists = lists.withColumn("Records", F.concat("Records", F.array(F.parse_json(F.lit("7")))))
    lists.repartition("part").write.partitionBy("part").json(path)
    return path


def xml_folder(spark, sf_dir) -> str:
    """Events as XML elements over several lines, below one root in each file."""
    path = scratch_path(spark, "xml")
    x = F.from_xml(_xml_lines(), winxml.XML_SCHEMA)
    _base(spark, sf_dir).select(x.alias("x")).select("x.*").write.format("xml").option("rowTag", "Event").option("rootTag", "Events").save(path)
    return path


@query("json_documents", f"WITH {B}, {JSON_TRUTH} SELECT * FROM j")
def json_documents(spark, sf_dir) -> DataFrame:
    """A1, A3: records of wrapped JSON documents, read from files."""
    return ln.read_logs(spark, json_documents_folder(spark, sf_dir)).select(
        F.col("ts").cast("timestamp_ntz").alias("ts"), "username", "source_ip", "hostname", "category", "status")


@query("winxml_files", f"WITH {B}, {XML_TRUTH} SELECT hostname, ts, event_id, channel, category, username, source_ip, command_line, message FROM x")
def winxml_files(spark, sf_dir) -> DataFrame:
    """A1, A4: events of XML files as tools export them."""
    return ln.read_logs(spark, xml_folder(spark, sf_dir)).select(
        "hostname", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "channel", "category", "username", "source_ip",
        "command_line", "message")


@query("file_rejects", f"""WITH {B} SELECT 'json' AS log_type, count(*) + count(DISTINCT seq // {DOCUMENT_RECORDS}) AS records,
  count(DISTINCT seq // {DOCUMENT_RECORDS}) AS rejected, 0 AS lost FROM b
UNION ALL SELECT 'winxml', count(*), 0, 0 FROM b""")
def file_rejects(spark, sf_dir) -> DataFrame:
    """Records found and rejected, by kind of file."""
    found = ln.file_rejects(spark, [json_documents_folder(spark, sf_dir), xml_folder(spark, sf_dir)])
    return found.groupBy("log_type").agg(
        F.sum("records").alias("records"), F.sum("rejected").alias("rejected"), F.count_if("lost").alias("lost"))
