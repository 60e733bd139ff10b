"""Every registered query against DuckDB on the same parquet files."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from carryover.plans.registry import QUERIES
from parity.check import differences
from tests.conftest import SF_DIR

ORACLE = entry.oracle_sql()


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", QUERIES)
def test_same_answer(spark, oracle, name):
    problems, rows = differences(QUERIES[name](spark, SF_DIR), oracle, ORACLE[name])
    assert not problems
    assert rows > 0


def test_entry(spark):
    assert len(entry.entry(spark).collect()) == 1
