"""Every registered query that SQL can express, against DuckDB on the smallest tables."""

import pytest

import __spark_entry__
from talkmill.jobs import queries
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows_as_sql(spark, name):
    assert differences(spark, SF, __spark_entry__.queries()[name], queries.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.FOUND) - set(queries.SQL)))
def test_others_run(spark, name):
    assert __spark_entry__.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
