"""The driver's contract."""

from __future__ import annotations

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["bucket", "observed", "mean", "std", "z", "severity"]
