"""What the driver plans at once, and what stays on the disks, in runs of many steps."""

import pytest
from pyspark.sql.readwriter import DataFrameWriter

from nightwarden.operators import rules as ru
from nightwarden.operators import thresholds as th

from . import helpers as h


@pytest.fixture
def written(monkeypatch):
    """How many operators each plan had that was written to a table."""
    sizes, write = [], DataFrameWriter.parquet

    def counted(self, path, *more, **named):
        sizes.append(self._df._jdf.queryExecution().optimizedPlan().toString().count("\n"))
        return write(self, path, *more, **named)

    monkeypatch.setattr(DataFrameWriter, "parquet", counted)
    return sizes


def test_detectors_are_planned_one_at_a_time(spark, written):
    """One plan of all detectors had over 200 operators, described anew at each of its stages."""
    ev = h.events(spark, [h.failure(user=f"u{i % 7}", at=10 * i) for i in range(30)] + [h.success(at=400 + i) for i in range(3)])
    found = th.detect(ev)
    assert max(written) < 130
    assert {r.rule_id for r in found.alerts().select("rule_id").distinct().collect()} >= {"threshold_brute_force_ip", "threshold_account_enum"}


def test_counting_rules_are_planned_one_at_a_time(spark, written):
    ev = h.events(spark, [h.failure(at=10 * i) for i in range(20)])
    rules = [r for r in ru.load_rules()[0] if r.counts]
    alerts, tagged = ru.detect(ev, rules)
    assert len(rules) > 1 and max(written) < 60 and tagged.count() > 0
