"""Routing and reading of raw log files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.alerts import union_all
from ..session import cut_lineage
from . import authlog, jsonlog, winxml

def log_type(file_name: Column) -> Column:
    """A1: the parser a file goes to, by name; the first hit wins, auth log is the default."""
    name = F.lower(file_name)
    return (
        F.when(name.rlike(r"\.(evtx|xml)$"), "winxml")
        .when(name.contains("auth") | name.contains("secure") | name.endswith(".log"), "authlog")
        .when(name.rlike(r"\.jsonl?$"), "json")
        .otherwise("authlog")
    )


def list_files(spark: SparkSession, paths) -> list[tuple[str, str, int]]:
    """(path, log type, bytes) of all files below the paths; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    name = F.element_at(F.split("path", "/"), -1)
    return [tuple(r) for r in files.select("path", log_type(name).alias("kind"), "length").collect()]


def _text(spark: SparkSession, files: list[str], **options) -> DataFrame:
    """Lines (or whole texts) of exactly these files."""
    schema = "value string, source_file string, file_name string, seq long"
    if not files:
        return spark.createDataFrame([], schema)
    # A file that can't be read is skipped and shows up in file_rejects.
    return spark.read.format("text").option("ignoreCorruptFiles", "true").options(**options).load(files).select(
        "value", F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_name").alias("file_name"),
        F.monotonically_increasing_id().alias("seq"))


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """One row per line. seq is unique and follows the line order inside each file."""
    return _text(spark, [p for p, _, _ in list_files(spark, paths)])


def parse_lines(lines: DataFrame, **auth_options) -> DataFrame:
    """A5: route every line by its file's name and put all parsers' events into one table.

    JSON lines are taken one object per line and XML one event per line here; read_logs takes files of any layout.
    """
    kind = log_type(F.col("file_name"))
    return union_all([
        authlog.parse(lines.filter(kind == "authlog"), **auth_options),
        jsonlog.parse(lines.filter(kind == "json")),
        winxml.parse(lines.filter(kind == "winxml")),
    ])


OBJECT_LINE = r"^\s*\{.*\}\s*$"
ITEM_LINE = r"^\s*\[?\s*(\{.*\})?\s*,?\s*\]?\s*$"


def json_layouts(lines: DataFrame) -> DataFrame:
    """(source_file, layout) of JSON files, by what is in them.

    items: one array, its records on lines of their own. document: one value over several lines, or a single line.
    lines: anything else, taken one object per line. Files are told apart by their first and last lines, whatever their
    size, so only documents that are laid out freely are ever read whole.
    """
    text = F.trim("value")
    first, last = F.col("first"), F.col("last")
    seen = lines.filter(text != "").groupBy("source_file").agg(
        F.count("*").alias("n"), F.min_by(text, "seq").alias("first"), F.max_by(text, "seq").alias("last"),
        F.bool_and(text.rlike(ITEM_LINE)).alias("items"))
    array = first.startswith("[")
    spread = ~first.rlike(OBJECT_LINE) & ~last.rlike(OBJECT_LINE)
    layout = (
        F.when(array & F.col("items") & (F.col("n") > 1), "items").when(array, "document")
        .when(first.startswith("{") & ((F.col("n") == 1) | spread), "document").otherwise("lines"))
    return seen.select("source_file", layout.alias("layout"))


def json_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """JSON files as one record per row, whatever their layout (columns value, source_file, file_name, seq)."""
    plain = [f for f in files if f.lower().endswith(".jsonl")]
    open_to_all = [f for f in files if f not in set(plain)]
    lines = _text(spark, open_to_all)
    layouts = cut_lineage(json_layouts(lines))
    free = [r[0] for r in layouts.filter("layout = 'document'").select("source_file").collect()]  # at most all files' names
    by_line = lines.join(layouts.filter("layout <> 'document'"), "source_file")
    item = F.regexp_replace("value", r"^\s*\[|,\s*$|\]\s*$|,\s*\]\s*$", "")
    item = F.when(F.col("layout") == "items", item).otherwise(F.col("value"))
    return union_all([
        _text(spark, plain),
        by_line.select(item.alias("value"), "source_file", "file_name", "seq").filter(F.trim("value") != ""),
        jsonlog.records(_text(spark, free, wholetext="true")),
    ])


def read_logs(spark: SparkSession, paths, **auth_options) -> DataFrame:
    """Events of all files below the paths.

    Files are listed once and each kind is read by its own reader, which opens its own files only: auth logs and JSON by
    line, JSON documents that are laid out freely as a whole, Windows events by their XML element.
    """
    files = list_files(spark, paths)

    def of(kind: str) -> list[str]:
        return [p for p, k, _ in files if k == kind]

    parts = [
        authlog.parse(_text(spark, of("authlog")), **auth_options),
        jsonlog.parse(json_records(spark, of("json")).withColumn("seq", F.monotonically_increasing_id())),
        winxml.parse_elements(winxml.read(spark, of("winxml"))),
    ]
    # seq is unique per scan; the part number keeps it unique over the union.
    return union_all([p.withColumn("seq", F.col("seq") * len(parts) + i) for i, p in enumerate(parts)])


def file_rejects(spark: SparkSession, paths) -> DataFrame:
    """Per file, how many records its reader found and how many of them it could not take.

    A file with content in which the reader finds nothing (broken or unreadable) is listed with 0 records and lost true.
    """
    files = list_files(spark, paths)

    def of(kind: str) -> list[str]:
        return [p for p, k, _ in files if k == kind]

    found = union_all([
        rejects(_text(spark, of("authlog"))).drop("log_type"),
        json_records(spark, of("json")).filter(F.trim("value") != "").groupBy("source_file").agg(
            F.count("*").alias("lines"), F.count_if(~jsonlog.is_record(F.col("value"))).alias("rejected")),
        winxml.read(spark, of("winxml")).groupBy("source_file").agg(
            F.count("*").alias("lines"), F.count_if(F.col("x.System").isNull()).alias("rejected"))])
    listed = spark.createDataFrame(files, "path string, log_type string, bytes long")
    name = F.regexp_replace(F.url_decode(F.regexp_replace("source_file", r"\+", "%2B")), "^([a-z0-9]+):/+", "$1:/")
    listed = listed.withColumn("__name", F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/"))
    rows = listed.join(found.withColumn("__name", name), "__name", "left")
    empty = F.coalesce("lines", F.lit(0)) == 0
    return rows.select(
        "path", "log_type", F.coalesce("lines", F.lit(0)).alias("records"), F.coalesce("rejected", F.lit(0)).alias("rejected"),
        (empty & (F.col("bytes") > 0)).alias("lost"))


def rejects(lines: DataFrame) -> DataFrame:
    """Per file, how many non-empty lines its parser could not read at all."""
    kind = log_type(F.col("file_name"))
    bad = (
        F.when(kind == "json", ~jsonlog.is_record(F.col("value")))
        .when(kind == "winxml", ~winxml.is_record(F.col("value")))
        .otherwise(F.lit(False))
    )
    return (
        lines.filter(F.trim("value") != "").withColumn("log_type", kind)
        .groupBy("source_file", "log_type")
        .agg(F.count("*").alias("lines"), F.count_if(bad).alias("rejected"))
    )
