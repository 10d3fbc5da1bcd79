"""Event predicates and projections (B1-B3). Missing fields make a predicate false, never NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def filled(col: Column) -> Column:
    """Neither NULL nor empty, for filters: plain comparisons reach the file scan."""
    return col != ""


def present(col: Column) -> Column:
    """Neither NULL nor empty, as a value."""
    return holds(filled(col))


def failed_auth() -> Column:
    """B1 for filters."""
    return ((F.col("category") == "authentication") & (F.col("status") == "failure")) | (F.col("event_id") == 4625)


def success_auth() -> Column:
    """B2 for filters."""
    return ((F.col("category") == "authentication") & (F.col("status") == "success")) | (F.col("event_id") == 4624)


def is_failed_auth() -> Column:
    return holds(failed_auth())


def is_success_auth() -> Column:
    return holds(success_auth())


def event_projection(events: DataFrame, *more: str | Column) -> DataFrame:
    """The event columns a result listing shows; message cut to 300 characters."""
    return events.select(
        "id", "source_type", "hostname", "ts", "event_id", "category", "username", "source_ip",
        "process_name", "command_line", "status", F.substring("message", 1, 300).alias("message"), *more,
    )
