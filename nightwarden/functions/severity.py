"""Severity, rule level and ATT&CK tag expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity weights and the level names rules use.
SEVERITY_WEIGHT = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
LEVEL_TO_SEVERITY = {
    "critical": "critical", "high": "high", "medium": "medium", "low": "low", "informational": "info",
}


def _lookup(table: dict, key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def severity_weight(severity: Column) -> Column:
    return _lookup(SEVERITY_WEIGHT, severity)


def level_to_severity(level: Column) -> Column:
    """Rule level text to severity; anything unknown (also a missing level) counts as medium."""
    return F.coalesce(_lookup(LEVEL_TO_SEVERITY, F.lower(level)), F.lit("medium"))


def title_case(text: Column) -> Column:
    """'credential_access' or 'credential-access' to 'Credential Access'."""
    return F.initcap(F.translate(text, "_-", "  "))


def attack_techniques(tags: Column) -> Column:
    return F.transform(
        F.filter(tags, lambda t: t.startswith("attack.t")),
        lambda t: F.upper(F.substr(t, F.lit(8))),
    )


def attack_tactics(tags: Column) -> Column:
    return F.transform(
        F.filter(tags, lambda t: t.startswith("attack.") & ~t.startswith("attack.t")),
        lambda t: title_case(F.substr(t, F.lit(8))),
    )
