"""Every registered query with SQL gives the same rows as DuckDB."""

import oracle_check
import pytest

import __spark_entry__ as entry

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return oracle_check.connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, sf, con, name):
    ok, why, _ = oracle_check.compare(QUERIES[name](spark, sf), con, ORACLE[name])
    assert ok, why


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
