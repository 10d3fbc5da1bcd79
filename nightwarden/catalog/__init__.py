"""Named queries over the test tables, each with its SQL counterpart where one exists."""

from . import alerts, anomaly, detectors, files, rules, sources, streams, whole  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
