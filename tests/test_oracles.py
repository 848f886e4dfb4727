"""Every registered query at the smallest scale: against its oracle, or non-empty where it has none."""

import pytest

import __spark_entry__ as entry
from check_oracles import compare

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    problem, rows = compare(spark, name, QUERIES[name], ORACLES.get(name), SF)
    if name in ORACLES:
        assert problem == ""
    assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
