"""JSON records to events (A3): candidate keys, typed fields, category and status detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import holds
from ..schema import event_columns, event_key

# Candidate keys per field, in order of preference.
TIMESTAMP_KEYS = ["@timestamp", "timestamp", "time", "eventTime", "TimeCreated", "created_at", "datetime", "date"]
USER_KEYS = ["user.name", "username", "user", "principalId", "actor.login", "initiatedBy.user.userPrincipalName"]
IP_KEYS = ["source.ip", "sourceIPAddress", "client_ip", "ip", "remote_addr", "client.ip", "src_ip"]
HOST_KEYS = ["host.name", "hostname", "host", "computer", "device"]
MESSAGE_KEYS = ["message", "msg", "log", "description", "eventName", "operationName"]
CATEGORY_KEYS = ["category", "event.category", "event_type", "type", "action"]
STATUS_KEYS = ["event.outcome", "outcome", "status", "result", "success"]
WRAPPER_KEYS = ["Records", "events", "logs"]

# Words that name a category (first hit wins) or an outcome.
CATEGORY_WORDS = {
    "authentication": "authentication", "login": "authentication", "logon": "authentication", "auth": "authentication",
    "process": "process", "network": "network", "connection": "network", "file": "file", "registry": "registry",
    "system": "system", "audit": "audit",
}
SUCCESS_WORDS = ["success", "succeeded", "ok", "200"]
FAILURE_WORDS = ["failure", "failed", "error", "denied", "unauthorized"]

# Words that make a record security relevant.
RELEVANT_WORDS = [
    "auth", "login", "logon", "fail", "error", "deny", "block", "attack", "malware", "suspicious", "anomal", "threat",
    "exploit", "privilege", "escalat", "lateral", "exfil", "command", "execution",
]


# Single keys that are read beside the candidate lists.
# Further keys that records are read by.
OTHER_KEYS = [
    "event.id", "event_id", "id", "process.name", "process", "process.command_line", "command_line", "destination.ip",
    "dest_ip", "tags", "labels",
]


def _paths() -> dict[tuple[str, ...], int]:
    """Every key path that is read (dotted keys and their parents), numbered."""
    found: dict[tuple[str, ...], int] = {}
    for dotted in [*TIMESTAMP_KEYS, *USER_KEYS, *IP_KEYS, *HOST_KEYS, *MESSAGE_KEYS, *CATEGORY_KEYS, *STATUS_KEYS, *OTHER_KEYS]:
        keys = tuple(dotted.split("."))
        for depth in range(len(keys), 0, -1):
            found.setdefault(keys[:depth], len(found))
    return found


PATHS = _paths()
NESTED = "^(OBJECT|ARRAY)"


def _value(record: Column, keys: tuple[str, ...]) -> Column:
    return F.try_variant_get(record, "$" + "".join(f"['{k}']" for k in keys), "variant")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _is_object(value: Column) -> Column:
    return holds(_kind(value).startswith("OBJECT"))


def fields(record: Column) -> Column:
    """All paths of a record in one array of (v, kind, text): each is looked up and typed once.

    The entry of an absent key is NULL; JSON null has kind VOID; text is that of a scalar.
    """
    values = F.array(*[_value(record, keys) for keys in PATHS])
    typed = F.transform(values, lambda v: F.when(v.isNotNull(), F.struct(v.alias("v"), _kind(v).alias("kind"))))
    return F.transform(typed, lambda x: F.when(x.isNotNull(), F.struct(
        x["v"].alias("v"), x["kind"].alias("kind"),
        F.when(~x["kind"].startswith("OBJECT") & ~x["kind"].startswith("ARRAY"), F.try_variant_get(x["v"], "$", "string"))
        .alias("text"))))


def _slot(keys: tuple[str, ...]) -> Column:
    """A path's entry in the column x; NULL when absent or JSON null."""
    entry = F.col("x")[PATHS[keys]]
    return F.when(entry["kind"] != "VOID", entry)


def lookup(dotted: str) -> Column:
    """Entry of a dotted key; where the path meets something that is no object, that value itself."""
    keys = tuple(dotted.split("."))
    found = [_slot(keys)]
    for depth in range(len(keys) - 1, 0, -1):
        parent = _slot(keys[:depth])
        found.append(F.when(~parent["kind"].startswith("OBJECT"), parent))
    return found[0] if len(found) == 1 else F.coalesce(*found)


def first_of(keys: list[str], scalar: bool = False) -> Column:
    """The first present candidate; scalar skips lists and objects."""
    entries = [lookup(k) for k in keys]
    if scalar:
        entries = [F.when(~e["kind"].rlike(NESTED), e) for e in entries]
    return F.coalesce(*entries)


def as_text(entry: Column) -> Column:
    """Text of any value; lists and objects as JSON."""
    return F.coalesce(entry["text"], F.try_variant_get(entry["v"], "$", "string"))


def string_only(entry: Column) -> Column:
    """Text of a JSON string; NULL for any other type."""
    return F.when(entry["kind"] == "STRING", entry["text"])


def _truthy(entry: Column) -> Column:
    """The entry unless it is empty, zero or false."""
    empty = F.coalesce(entry["text"].isin("", "0", "0.0", "false"), F.lit(False)) | entry["kind"].isin("OBJECT<>", "ARRAY<VOID>")
    return F.when(~empty, entry)


def as_time(entry: Column) -> Column:
    """Numbers are epoch seconds, above 1e10 milliseconds; text is ISO 8601; anything else is unreadable."""
    number = F.when(entry["kind"].rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), entry["text"].try_cast("double"))
    seconds = F.when(number > 1e10, number / 1000).otherwise(number)
    text = string_only(entry)
    return (
        F.when(number.isNotNull(), F.timestamp_micros(F.round(seconds * 1_000_000).cast("long")))
        .when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))
    )


def _category_of(text: Column) -> Column:
    low = F.lower(text)
    return reduce(
        lambda chain, item: chain.when(low.contains(item[0]), item[1]), CATEGORY_WORDS.items(), F.when(F.lit(False), ""))


def detect_category() -> Column:
    """A3d: by key, then list item, then word; unknown when nothing fits."""
    texts = F.lit(None).cast("array<string>")
    for key in CATEGORY_KEYS:
        entry = lookup(key)
        items = F.transform(
            F.filter(F.try_variant_get(entry["v"], "$", "array<variant>"), lambda item: holds(_kind(item) == "STRING")),
            lambda item: F.try_variant_get(item, "$", "string"))
        here = F.when(entry["kind"] == "STRING", F.array(entry["text"])).when(entry["kind"].startswith("ARRAY"), items)
        here = F.coalesce(here, F.array().cast("array<string>"))
        texts = here if key == CATEGORY_KEYS[0] else F.concat(texts, here)
    named = F.array_compact(F.transform(texts, _category_of))
    return F.coalesce(F.try_element_at(named, F.lit(1)), F.lit("unknown"))


def detect_status() -> Column:
    """A3e: outcome words or booleans; any other value leaves the decision to the next key."""
    found = []
    for key in STATUS_KEYS:
        entry = lookup(key)
        word = F.lower(string_only(entry))
        flag = F.when(entry["kind"] == "BOOLEAN", entry["text"])
        found.append(
            F.when(word.isin(SUCCESS_WORDS) | (flag == "true"), "success")
            .when(word.isin(FAILURE_WORDS) | (flag == "false"), "failure"))
    return F.coalesce(*found)


def tag_list(entry: Column) -> Column:
    """A3g: a list as texts, an object as key:value texts."""
    pairs = F.map_entries(F.try_variant_get(entry["v"], "$", "map<string,string>"))
    return F.coalesce(
        F.when(entry["kind"].startswith("ARRAY"), F.try_variant_get(entry["v"], "$", "array<string>")),
        F.when(entry["kind"].startswith("OBJECT"), F.transform(pairs, lambda e: F.concat(e["key"], F.lit(":"), e["value"]))),
        F.array().cast("array<string>"))


def is_relevant(text: Column) -> Column:
    """A3h: any of the relevance words in the record's text; cheap enough to run before parsing."""
    return F.lower(text).rlike("|".join(RELEVANT_WORDS))


def parse_text(text: Column) -> Column:
    """The text's single JSON value in an array of one; NULL unless the whole text is one value.

    The parser itself stops after the first value and ignores the rest, so the text is read as the only item of a list.
    """
    items = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    return F.flatten(F.transform(F.array(items), lambda a: F.when(F.size(a) == 1, a)))


def is_record(text: Column) -> Column:
    return holds(F.exists(parse_text(text), _is_object))


def records(documents: DataFrame) -> DataFrame:
    """Rows of whole JSON files to one row per record, object or not: line by line, or the items of a list.

    A file with line breaks that does not start with a bracket is taken as one object per line; if its whole text is
    one JSON value (pretty-printed), that value is used.
    """
    text = F.regexp_replace("value", r"^\s+|\s+$", "")
    docs = documents.withColumn("text", text).withColumn("doc", F.try_element_at(parse_text(F.col("text")), F.lit(1)))
    by_line = F.flatten(F.transform(
        F.split("text", r"\R"), lambda t: F.coalesce(parse_text(t), F.array().cast("array<variant>"))))
    wrapped = F.coalesce(*[
        F.when(_kind(_value(F.col("doc"), (k,))).startswith("ARRAY"), F.try_variant_get("doc", f"$.{k}", "array<variant>"))
        for k in WRAPPER_KEYS])
    array = F.col("text").startswith("[") & F.col("text").endswith("]")
    items = (  # a list too large for one value is read item by item
        F.when(F.col("doc").isNull() & array, F.coalesce(F.from_json("text", "array<variant>"), by_line))
        .when(F.col("doc").isNull(), by_line)
        .when(_kind(F.col("doc")).startswith("ARRAY"), F.try_variant_get("doc", "$", "array<variant>"))
        .otherwise(F.coalesce(wrapped, F.array("doc"))))
    return (
        docs.select("source_file", "file_name", F.explode(items).alias("record"))
        .select(F.to_json("record").alias("value"), "source_file", "file_name", F.monotonically_increasing_id().alias("seq")))


def parse(lines: DataFrame, security_only: bool = False, default_ts: Column | None = None) -> DataFrame:
    """Events of JSON lines (columns value, source_file, seq); lines that are no JSON object are skipped."""
    if security_only:
        lines = lines.filter(is_relevant(F.col("value")))
    # A generator instead of a filter, so that the text is parsed once.
    parsed = lines.select(
        "seq", "source_file", "value", F.explode(F.filter(parse_text(F.col("value")), _is_object)).alias("v"))
    found = parsed.withColumn("x", fields(F.col("v"))).select(
        "seq", "source_file", "value", "v",
        first_of(TIMESTAMP_KEYS).alias("time"),
        first_of(USER_KEYS, scalar=True)["text"].alias("user"),
        first_of(IP_KEYS, scalar=True)["text"].alias("ip"),
        _truthy(first_of(HOST_KEYS, scalar=True))["text"].alias("host"),
        first_of(MESSAGE_KEYS).alias("message"),
        F.coalesce(_truthy(lookup("event.id")), _truthy(_slot(("event_id",))), _truthy(_slot(("id",)))).alias("nr"),
        F.coalesce(_truthy(lookup("process.name")), _slot(("process",))).alias("process"),
        F.coalesce(_truthy(lookup("process.command_line")), _slot(("command_line",))).alias("command"),
        F.coalesce(_truthy(lookup("destination.ip")), _slot(("dest_ip",))).alias("destination"),
        F.coalesce(_truthy(_slot(("tags",))), _slot(("labels",))).alias("tags"),
        detect_category().alias("category"),
        detect_status().alias("status"),
    ).withColumn("read_ts", as_time(F.col("time")))
    message = as_text(F.col("message"))
    return found.select(*event_columns(
        seq=F.col("seq"),
        id=event_key(F.col("source_file"), F.col("seq"), F.col("value")),
        source_type=F.lit("json"),
        source_file=F.col("source_file"),
        hostname=F.col("host"),
        ts=F.col("read_ts") if default_ts is None else F.coalesce("read_ts", default_ts),
        ts_ok=F.col("read_ts").isNotNull(),
        event_id=F.when(F.col("nr.kind") == "BIGINT", F.col("nr.text").try_cast("int")),
        category=F.col("category"),
        username=F.col("user"),
        source_ip=F.col("ip"),
        dest_ip=string_only(F.col("destination")),
        process_name=string_only(F.col("process")),
        command_line=string_only(F.col("command")),
        status=F.col("status"),
        message=F.coalesce(F.substring(message, 1, 500), F.substring(F.to_json("v"), 1, 300)),
        raw=F.create_map(F.lit("json"), F.col("value")),
        tags=tag_list(F.col("tags")),
    ))
