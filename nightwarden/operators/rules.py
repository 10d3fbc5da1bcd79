"""Declarative rules (C1-C17): YAML files compiled to boolean columns, evaluated for all rules in one scan."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import timedelta
from functools import reduce
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import holds
from ..functions.severity import attack_tactics, attack_techniques, level_to_severity, severity_weight
from ..schema import EVENT_SCHEMA, with_micros
from ..session import cut_union
from .alerts import EVIDENCE_EVENT_COLUMNS, complete, evidence, roll_up, union_all
from .ordered import CHUNK_ROWS, next_mark, running_count, shifted, spaced_picks

BUNDLED_RULES = Path(__file__).resolve().parent.parent / "rules"
RULES_PER_SCAN = 200

# Rule field names (any case) and the event column each stands for.
FIELD_ALIASES = {
    "eventid": "event_id",
    "channel": "channel",
    "computer": "hostname",
    "hostname": "hostname",
    "user": "username",
    "subjectusername": "username",
    "targetusername": "username",
    "ipaddress": "source_ip",
    "sourceip": "source_ip",
    "workstationname": "source_ip",
    "commandline": "command_line",
    "image": "process_name",
    "newprocessname": "process_name",
    "processname": "process_name",
    "parentimage": "parent_process",
    "parentprocessname": "parent_process",
    "message": "message",
    "timestamp": "ts",
}
# Rule fields that live in the raw record, and their key there.
RAW_ALIASES = {"servicename": "ServiceName", "taskname": "TaskName"}

_COUNT = re.compile(r"^\s*(\w+)\s*\|\s*count\(\)\s*([<>=!]+)\s*(\d+)\s*$", re.IGNORECASE)
_TIMEFRAME = re.compile(r"^\s*(\d+)\s*([smhd])\s*$")
_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "d": "days"}
_TYPES = {f.name: f.dataType for f in EVENT_SCHEMA.fields}


class RuleError(ValueError):
    """A rule that cannot be evaluated as written."""


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    description: str
    level: str | None
    tags: list[str]
    logsource: dict = field(default_factory=dict)
    selections: dict = field(default_factory=dict)
    condition: str = "selection"
    timeframe: timedelta | None = None

    @property
    def counts(self) -> bool:
        return _COUNT.match(self.condition) is not None

    def threshold(self, parity: bool = False) -> int:
        """Matches needed to fire. parity: the reference ignores the comparison sign and takes the bare number."""
        _, sign, number = _COUNT.match(self.condition).groups()
        if parity:
            return int(number)
        if sign not in (">", ">=", "=", "=="):
            raise RuleError(f"count() {sign} cannot be decided while events still arrive")
        return int(number) + (1 if sign == ">" else 0)


def parse_rule(data: dict, stem: str) -> Rule:
    """One rule from its YAML mapping; raises RuleError when it could not be evaluated."""
    if not isinstance(data, dict) or not isinstance(data.get("detection"), dict):
        raise RuleError("no detection section")
    detection = dict(data["detection"])
    condition = str(detection.pop("condition", "selection"))
    timeframe = detection.pop("timeframe", None)
    if timeframe is not None:
        m = _TIMEFRAME.match(str(timeframe))
        if not m:
            raise RuleError(f"timeframe {timeframe!r}")
        timeframe = timedelta(**{_UNITS[m.group(2)]: int(m.group(1))})
    rule = Rule(
        id=str(data.get("id", stem)), title=str(data.get("title", stem)), description=str(data.get("description", "")).strip(),
        level=data.get("level"), tags=[str(t) for t in data.get("tags") or []], logsource=data.get("logsource") or {},
        selections=detection, condition=condition, timeframe=timeframe)
    for name, body in detection.items():
        check_selection(name, body)
    if rule.counts:
        rule.threshold()
        _named(rule, _COUNT.match(condition).group(1))
    else:
        condition_text(rule, lambda name: name)
    return rule


def load_rules(folder: str | Path = BUNDLED_RULES) -> tuple[list[Rule], list[tuple[str, str]]]:
    """Rules below a folder in path order, and (file, reason) for those that cannot be used."""
    rules, rejected = [], []
    files = sorted(p for p in Path(folder).rglob("*") if p.suffix in (".yml", ".yaml"))
    for path in files:
        try:
            rules.append(parse_rule(yaml.safe_load(path.read_text(encoding="utf-8")), path.stem))
        except (RuleError, yaml.YAMLError, UnicodeDecodeError) as exc:
            rejected.append((str(path), str(exc)))
    return rules, rejected


# ---- fields and selections -------------------------------------------------------------------------------------

def field_column(name: str) -> Column:
    """The event column a rule field stands for; a field no event has is always NULL."""
    key = name.lower()
    if key in RAW_ALIASES:
        return F.try_element_at("raw", F.lit(RAW_ALIASES[key]))
    key = FIELD_ALIASES.get(key, key)
    return F.col(key) if key in _TYPES else F.lit(None).cast("string")


def _field_type(name: str) -> T.DataType:
    key = FIELD_ALIASES.get(name.lower(), name.lower())
    return _TYPES.get(key, T.StringType())


def _modifiers(field_expr: str) -> tuple[str, frozenset]:
    name, *mods = str(field_expr).split("|")
    mods = frozenset(m.lower() for m in mods)
    if mods not in ({frozenset(), frozenset({"contains", "all"})} | {
            frozenset({m}) for m in ("contains", "startswith", "endswith", "re")}):
        raise RuleError(f"modifiers of {field_expr!r}")
    return name, mods


def check_selection(name: str, body) -> None:
    """Reject what could never match or would fail later: unknown modifiers, broken patterns, odd shapes."""
    if isinstance(body, list):
        return
    if not isinstance(body, dict):
        raise RuleError(f"selection {name!r} is neither fields nor keywords")
    for field_expr, value in body.items():
        _, mods = _modifiers(field_expr)
        if "re" in mods:
            for pattern in value if isinstance(value, list) else [value]:
                try:
                    re.compile(str(pattern))
                except re.error as exc:
                    raise RuleError(f"pattern {pattern!r}: {exc}") from exc


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _text_test(mods: frozenset, values: list) -> Callable[[Column], Column]:
    words = [str(v).lower() for v in values]
    if not mods:
        return lambda text: text.isin(words)
    if mods == {"contains", "all"}:
        return lambda text: _all([text.contains(w) for w in words])
    if mods == {"contains"}:
        return lambda text: _any([text.contains(w) for w in words])
    if mods == {"startswith"}:
        return lambda text: _any([text.startswith(w) for w in words])
    if mods == {"endswith"}:
        return lambda text: _any([text.endswith(w) for w in words])
    return lambda text: _any([text.rlike(f"(?i){v}") for v in values])


def _whole(values: list) -> list[int] | None:
    """The values as integers if each is the plain text of one."""
    if all(re.fullmatch(r"-?(0|[1-9]\d*)", str(v)) for v in values):
        return [int(v) for v in values]
    return None


def match_field(field_expr: str, expected) -> Column:
    """One field test. Text is compared in lower case; a missing value never matches."""
    name, mods = _modifiers(field_expr)
    col, kind = field_column(name), _field_type(name)
    values = expected if isinstance(expected, list) else [expected]
    wants_null = any(v is None for v in values)
    values = [v for v in values if v is not None]
    test = _text_test(mods, values)
    if isinstance(kind, T.ArrayType):
        found = holds(F.exists(col, lambda item: test(F.lower(item))))
    elif isinstance(kind, T.IntegralType) and not mods and _whole(values):
        found = holds(col.isin(_whole(values)))
    elif isinstance(kind, T.MapType):
        found = holds(test(F.lower(F.to_json(col))))
    else:
        found = holds(test(F.lower(col.cast("string"))))
    return found | col.isNull() if wants_null else found


def log_line() -> Column:
    """What keyword lists search: the raw line where there is one, else the message."""
    return F.coalesce(F.try_element_at("raw", F.lit("line")), F.col("message"))


def match_keywords(words: list, line: Column) -> Column:
    """Any of the phrases, in any case."""
    low = F.lower(line)
    return holds(_any([low.contains(str(w).lower()) for w in words]))


def match_selection(body) -> Column:
    """C11: all fields of a selection; a list of phrases is a keyword search."""
    if isinstance(body, list):
        plain = [w for w in body if not isinstance(w, dict)]
        maps = [match_selection(w) for w in body if isinstance(w, dict)]
        return _any([*maps, *([match_keywords(plain, log_line())] if plain else [])])
    return _all([match_field(f, v) for f, v in body.items()])


# ---- conditions ------------------------------------------------------------------------------------------------

def _named(rule: Rule, name: str) -> str:
    for known in rule.selections:
        if known.lower() == name.lower():
            return known
    raise RuleError(f"condition names unknown selection {name!r}")


def condition_text(rule: Rule, column_of: Callable[[str], str]) -> str:
    """The condition as a Spark SQL boolean expression over selection columns.

    Only selection names, and/or/not and parentheses pass; precedence and nesting are Spark's.
    """
    text = rule.condition

    def expand(m: re.Match) -> str:
        pattern = m.group(2).lower()
        names = [n for n in rule.selections if pattern == "them" or
                 (n.lower().startswith(pattern[:-1]) if pattern.endswith("*") else n.lower() == pattern)]
        if not names:
            raise RuleError(f"no selection for {m.group(0)!r}")
        return "(" + (" or " if m.group(1).lower() in ("1", "any") else " and ").join(names) + ")"

    text = re.sub(r"\b(1|any|all)\s+of\s+([\w*]+)", expand, text, flags=re.IGNORECASE)
    out = []
    for token in re.findall(r"[\w-]+|[()]|\S", text):
        if token.lower() in ("and", "or", "not") or token in "()":
            out.append(token.lower())
        elif re.fullmatch(r"[\w-]+", token):
            out.append(f"`{column_of(_named(rule, token))}`")
        else:
            raise RuleError(f"unsupported {token!r} in condition {rule.condition!r}")
    if not out:
        raise RuleError("empty condition")
    return " ".join(out)


def with_matches(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add one boolean column per rule, __rule_<n>: its condition, or for a counting rule what it counts."""
    columns, conditions = {}, {}
    for i, rule in enumerate(rules):
        for j, body in enumerate(rule.selections.values()):
            columns[f"__sel_{i}_{j}"] = match_selection(body)
        names = {name: f"__sel_{i}_{j}" for j, name in enumerate(rule.selections)}
        if rule.counts:
            conditions[f"__rule_{i}"] = F.col(names[_named(rule, _COUNT.match(rule.condition).group(1))])
        else:
            conditions[f"__rule_{i}"] = F.expr(condition_text(rule, names.__getitem__))
    return events.withColumns(columns).withColumns(conditions).drop(*columns)


def match_rules(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """C14: one row per (event, matching rule), with the rule's position in rule_ord; a single scan per rule group."""
    parts = []
    for begin in range(0, len(rules), RULES_PER_SCAN):
        group = rules[begin:begin + RULES_PER_SCAN]
        hits = F.array(*[F.when(F.col(f"__rule_{i}"), F.lit(begin + i)) for i in range(len(group))])
        parts.append(
            with_matches(events, group)
            .withColumn("rule_ord", F.explode(F.array_compact(hits)))
            .drop(*[f"__rule_{i}" for i in range(len(group))]))
    return union_all(parts)


# ---- alerts ----------------------------------------------------------------------------------------------------

_TABLE = "rule_ord int, rule_id string, rule_name string, about string, level string, tags array<string>"


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """The rules as a table: severity from the level, techniques and tactics from the tags."""
    rows = [(i, r.id, r.title, r.description, r.level, r.tags) for i, r in enumerate(rules)]
    severity = level_to_severity(F.col("level"))
    return spark.createDataFrame(rows, _TABLE).withColumns({
        "severity": severity,
        "weight": severity_weight(severity),
        "techniques": attack_techniques(F.col("tags")),
        "tactics": attack_tactics(F.col("tags")),
    })


def rules_by_severity(table: DataFrame) -> DataFrame:
    """C17: most severe first, at most two techniques shown."""
    return (
        table.withColumn("techniques", F.slice("techniques", 1, 2))
        .orderBy(F.col("weight").desc(), "rule_ord")
    )


def _rule_id(rules: list[Rule]) -> Column:
    return F.element_at(F.array(*[F.lit(r.id) for r in rules]), F.col("rule_ord") + 1)


def single_evidence(events: DataFrame, rules: list[Rule]) -> DataFrame:
    """Evidence of the rules that fire on one event."""
    plain = [r for r in rules if not r.counts]
    hits = with_micros(match_rules(events, plain))
    return evidence(hits, _rule_id(plain), "host", F.col("hostname"), F.col("seq"))


def count_evidence(
    events: DataFrame, rule: Rule, window: timedelta = timedelta(minutes=5), threshold: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Per host and address, fire at n matches within the window, then count from zero.

    The matches held at a firing are exactly the last n. So a match can fire if the match n-1 before it is within
    the window, and firings are n or more matches apart: a spaced choice (W2).
    """
    n = threshold or rule.threshold()
    width = (rule.timeframe or window) // timedelta(microseconds=1)
    key = ["hostname", "__ip"]
    matches = (
        with_micros(with_matches(events, [rule]).filter("__rule_0")).select(*EVIDENCE_EVENT_COLUMNS)
        .withColumn("__ip", F.coalesce("source_ip", F.lit("")))
    )
    ranked = running_count(matches, key, "rank")
    able = (
        shifted(ranked, key, "us", 1 - n, "__nth_us", chunk_rows=chunk_rows)
        .filter(F.col("us") - F.col("__nth_us") <= width).select(*key, "rank"))
    fired = spaced_picks(able, key, n, chunk_rows)
    held = next_mark(ranked, fired, key, chunk_rows).filter(F.col("mark") - F.col("rank") < n)
    return evidence(held, rule.id, "host_ip", F.concat_ws("|", "hostname", "__ip"), F.col("mark"))


def to_alerts(found: DataFrame, table: DataFrame) -> DataFrame:
    """Alerts from evidence and the rule table (a few rows per rule file, hence broadcast)."""
    meta = F.broadcast(table.drop("level", "tags", "weight"))
    return complete(
        roll_up(found).join(meta, "rule_id"),
        rule_name=F.col("rule_name"), rule_source="sigma", rule_ord=F.col("rule_ord"), description=F.col("about"),
        severity=F.col("severity"), techniques=F.col("techniques"), tactics=F.col("tactics"))


def detect(
    events: DataFrame, rules: list[Rule], window: timedelta = timedelta(minutes=5), parity: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """All rules over all events; returns (alerts, evidence)."""
    found = []
    if any(not r.counts for r in rules):
        found.append(single_evidence(events, rules))
    found += [count_evidence(events, r, window, r.threshold(parity)) for r in rules if r.counts]
    tagged = cut_union(found)
    return to_alerts(tagged, rules_table(events.sparkSession, rules)), tagged
