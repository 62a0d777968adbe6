"""Every query with SQL against DuckDB, every other one for a stable schema."""

from __future__ import annotations

import pytest
from oracle_check import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle_sql()
# Joined to lines: run once more as if no table could be broadcast.
SHUFFLED = [name for name in QUERIES if name.startswith("q_")]


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SF_DIR), duck, SQL[name]) == []


@pytest.mark.parametrize("name", SHUFFLED)
def test_pre_aggregated_query_equals_sql(spark, duck, no_broadcast, name):
    assert compare(QUERIES[name](spark, SF_DIR), duck, SQL[name]) == []


def test_entry(spark):
    assert entry(spark).count() > 0
